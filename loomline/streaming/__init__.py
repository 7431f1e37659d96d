"""Loomline streaming."""
