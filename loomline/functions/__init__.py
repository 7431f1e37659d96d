"""Loomline functions."""
