"""Admission control and incremental loads, in batch and as streams."""
