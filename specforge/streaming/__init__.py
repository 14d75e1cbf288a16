"""Streaming of the catalogue engine."""
