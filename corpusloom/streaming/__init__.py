"""File changes as batches and as streams."""
