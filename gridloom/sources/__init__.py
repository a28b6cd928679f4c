"""Readers of asset tables and sectioned text."""
