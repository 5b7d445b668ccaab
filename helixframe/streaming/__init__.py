"""Sequence operators on streams."""
