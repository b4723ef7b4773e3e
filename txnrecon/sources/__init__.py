"""Readers of loose input and the registry of mail sources."""
