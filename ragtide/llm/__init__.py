"""Operators of a large-scale training-data pipeline (text extraction, dedup, quality, mixing, tokens)."""
