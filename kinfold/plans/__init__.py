"""Queries composed from operators, with the SQL they are checked against."""
