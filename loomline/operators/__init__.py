"""Loomline operators."""
