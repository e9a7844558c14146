"""Operators of a training-data pipeline: texts, tokens, near copies, filters."""
