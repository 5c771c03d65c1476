"""Physical forms above the DataFrame API: positions, blocks and halos."""
