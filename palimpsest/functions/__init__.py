"""Byte-level functions that SQL has no form for."""
