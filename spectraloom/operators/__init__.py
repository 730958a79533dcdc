"""Spectraloom operators."""
