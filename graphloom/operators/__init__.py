"""Operators over sources and graphs."""
