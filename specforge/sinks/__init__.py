"""Sinks of the catalogue engine."""
