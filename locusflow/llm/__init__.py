"""Operators that prepare text and pages for model training."""
