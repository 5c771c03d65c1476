"""Operators on groups of variables; the facade in cellweave.frame calls them."""
