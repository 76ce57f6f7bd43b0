"""Graphs out of prose, tables and JSON, as Spark DataFrames."""

from .annotate import AnnotatedGraph, Annotation, GraphRenderer, RenderArtifact, Selection
from .evidence import Confidence, Evidence, Provenance, TextPositionSelector, TextQuoteSelector, attribute_evidence, set_attribute_evidence
from .grammar_formats import generate_json_schema, generate_pydantic, load_linkml, to_linkml
from .graph import Edge, Graph, Node
from .operators.context import Cache, DictCache, ExtractedEdge, ExtractedNode, Extraction, ExtractionContext, Extractor, NullCache, available_extractors, build_extractor, register_extractor
from .operators.patterns import RegexEdgeExtractor, RegexNodeExtractor
from .operators.reify import reify, unreify
from .operators.resolution import CascadeResolver, LLMResolver, NormalizeResolver, RegistryResolver, Resolver, resolve_graph
from .operators.trace import TraceIndex, reanchor, verify_anchor
from .operators.validation import GraphValidationError, ValidationIssue, validate_graph
from .operators.verify import (
    Composite,
    ExactMatch,
    GraphMatch,
    LLMRubric,
    NormalizedMatch,
    NumericTolerance,
    SchemaConstraint,
    SemanticSimilarity,
    SetMatch,
    Verdict,
    VerificationContext,
    available_verifiers,
    build_verifier,
    register_verifier,
    schema_description_verifier,
)
from .plans import CaseResult, CorpusCase, CorpusResult, ExtractionPolicy, ExtractorBinding, ExtractorBindings, evaluate_case, evaluate_corpus, extract
from .sinks import (
    CANONICAL_VERSION,
    from_canonical_dict,
    from_canonical_json,
    to_canonical_dict,
    to_canonical_json,
    to_cypher,
    to_cytoscape,
    to_dot,
    to_embedding_records,
    to_graphml,
    to_jgf,
    to_mermaid,
    to_node_edge_records,
    to_table,
    to_turtle,
    validate_canonical,
)
from .sources import Source, SourceBundle, coerce_sources, ingest, ingest_paths
from .spec import AttrSchema, EdgeType, ElementType, EnumDef, GraphSpec, NodeType, effective_attributes, to_struct_type

__all__ = [n for n in dir() if not n.startswith("_")]
