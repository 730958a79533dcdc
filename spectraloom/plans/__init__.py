"""Spectraloom plans."""
