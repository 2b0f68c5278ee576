"""Relational and geometric operators over nodes, ways and relations."""
