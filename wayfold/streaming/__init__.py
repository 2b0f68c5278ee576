"""Queries over streams of elements."""
