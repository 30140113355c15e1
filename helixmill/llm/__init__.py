"""Operators for training-data pipelines: mergeable sketches, tokenization, source mixing and sentence boundaries."""
