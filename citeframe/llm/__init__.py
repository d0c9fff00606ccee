"""Operators for large training corpora: dedup, screening, formatting, mixing and scoring."""
