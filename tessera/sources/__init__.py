"""Tessera: sources."""
