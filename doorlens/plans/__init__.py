"""Registered queries over the given tables, with the SQL each is checked against."""
