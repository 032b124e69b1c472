"""Composite reports."""
