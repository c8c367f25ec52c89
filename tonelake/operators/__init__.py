"""Relational operators over packet, page and stream tables."""
