"""Labelled-array analytics on Spark DataFrames."""

from .frame import Lattice, apply_named
from .plans.windows import Layout

__all__ = ["Lattice", "Layout", "apply_named"]
