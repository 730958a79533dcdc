"""Spectraloom functions."""
