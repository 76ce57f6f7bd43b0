"""Graphs that grow while sources arrive."""

from .incremental import KeyedMerge, upsert_nodes

__all__ = ["KeyedMerge", "upsert_nodes"]
