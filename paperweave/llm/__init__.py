"""Operators of a training-data pipeline: cleaning, scoring, near copies, search, tokens and packing."""
