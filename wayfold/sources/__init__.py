"""Readers: map extracts, tables, place catalogues, the star-schema view."""
