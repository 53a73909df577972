"""Tessera: streaming."""
