"""Catalogue enrichment and analytics on Spark DataFrames."""
