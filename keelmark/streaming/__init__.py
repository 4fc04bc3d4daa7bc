"""Incremental runs of the batch projections."""
