"""Training-data operators: language ID, deduplication, decontamination, scoring, tokens and packing.

Nothing outside this subpackage imports it.
"""
