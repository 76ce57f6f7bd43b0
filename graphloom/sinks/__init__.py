"""Graphs as canonical JSON, records and exchange formats."""

from .canonical import CANONICAL_VERSION, SCHEMA_ID, from_canonical_dict, from_canonical_json, to_canonical_dict, to_canonical_json, validate_canonical
from .digest import graph_digest, merged_digests, same_graph
from .documents import Document, array_document, canonical_document, dot_document, graphml_document, jgf_document, mermaid_document, table_document, turtle_document
from .exports import cypher_rows, to_cypher, to_graphml, to_jgf, to_turtle, turtle_rows
from .views import cytoscape_rows, embedding_rows, record_rows, to_cytoscape, to_dot, to_embedding_records, to_mermaid, to_node_edge_records, to_table, typed_view

__all__ = [
    "CANONICAL_VERSION",
    "Document",
    "SCHEMA_ID",
    "array_document",
    "canonical_document",
    "cypher_rows",
    "cytoscape_rows",
    "dot_document",
    "embedding_rows",
    "from_canonical_dict",
    "from_canonical_json",
    "graph_digest",
    "graphml_document",
    "jgf_document",
    "merged_digests",
    "mermaid_document",
    "record_rows",
    "same_graph",
    "table_document",
    "to_canonical_dict",
    "to_canonical_json",
    "to_cypher",
    "to_cytoscape",
    "to_dot",
    "to_embedding_records",
    "to_graphml",
    "to_jgf",
    "to_mermaid",
    "to_node_edge_records",
    "to_table",
    "to_turtle",
    "turtle_document",
    "turtle_rows",
    "typed_view",
    "validate_canonical",
]
