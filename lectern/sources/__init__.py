"""Scans: text, charset detection, EPUB, HTML."""
