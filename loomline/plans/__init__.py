"""Loomline plans."""
