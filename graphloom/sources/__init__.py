"""Inputs: text, tables and JSON, and the files they come from."""

from .bundle import JSON, TABLE, TEXT, Source, SourceBundle, coerce_sources
from .loaders import ingest, ingest_paths, loader_for, register_loader, supported_extensions

__all__ = ["JSON", "TABLE", "TEXT", "Source", "SourceBundle", "coerce_sources", "ingest", "ingest_paths", "loader_for", "register_loader", "supported_extensions"]
