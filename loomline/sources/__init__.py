"""Loomline sources."""
