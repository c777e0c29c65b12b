"""Operators on document text and tokens."""
