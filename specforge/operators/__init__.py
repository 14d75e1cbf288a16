"""Operators of the catalogue engine."""
