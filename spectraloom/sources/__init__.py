"""Spectraloom sources."""
