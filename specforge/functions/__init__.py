"""Functions of the catalogue engine."""
