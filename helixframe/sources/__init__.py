"""Readers and writers of sequence formats, on Spark's own file readers."""
