"""Queries over the given tables, with the SQL each of them is compared to."""
