"""Resumable batches over files."""
