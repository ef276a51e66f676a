"""Operators of a training-data pipeline: decontamination, deduplication,
extraction, toxicity, language mixture, token counts and packing.

Nothing else in the library imports this subpackage.
"""
