"""Batch and shared operators."""
