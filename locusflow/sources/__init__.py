"""Readers and writers of alignment, variant, sequence and interval files."""
