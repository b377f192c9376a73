"""Relational operators of the document library."""
