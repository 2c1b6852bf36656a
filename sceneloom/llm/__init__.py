"""Operators of a training-data pipeline: cleaning, matching, splitting and encoding of texts."""
