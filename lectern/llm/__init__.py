"""Corpus-preparation operators (optional; nothing else in the package imports this)."""
