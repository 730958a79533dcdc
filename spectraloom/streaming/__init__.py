"""Spectraloom streaming."""
