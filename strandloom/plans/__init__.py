"""Queries that bind the operators to tables, with the SQL each is checked against."""
