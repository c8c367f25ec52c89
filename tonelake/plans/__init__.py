"""Registered queries and their SQL statements."""
