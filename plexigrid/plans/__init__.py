"""Queries over the given tables, with the SQL that each is checked against."""
