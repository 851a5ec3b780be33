"""Batches and run stores."""
