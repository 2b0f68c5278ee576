"""The declarative query, its rules and its compilation to Catalyst expressions."""
