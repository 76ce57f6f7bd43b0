"""One call: sources, grammar and bindings in, graph out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..graph import STAGED_EDGES, STAGED_NODES, Graph
from ..operators import language_model, patterns, records  # noqa: F401  (they register their strategies)
from ..operators.assembly import assemble
from ..operators.context import ExtractionContext, NullCache
from ..operators.resolution import resolve_graph
from ..sources import coerce_sources
from ..spec import ElementType, GraphSpec
from ..storage import stored
from .bindings import coerce_bindings, join, routed

SCHEMA_AS_EXTRACTOR, SKIP, ERROR = "schema_as_extractor", "skip", "error"


def extract(
    sources: Any,
    graph_spec: GraphSpec,
    extractors: Any = None,
    *,
    spark: SparkSession | None = None,
    cache: Any = None,
    services: Mapping[str, Any] | None = None,
    on_missing_binding: str = SCHEMA_AS_EXTRACTOR,
    schema_as_extractor: Callable[[ElementType, GraphSpec], Any] | None = None,
    resolve: Any = None,
) -> Graph:
    """Fill the grammar from the sources.

    Elements without a binding go to a language model (the service ``llm``, or
    the given factory), are skipped, or are an error. The steps' rows are
    written once to the shared folder; the graph is a lazy plan over them. The
    check for doubled edge ids runs at once.
    """
    spark = spark or SparkSession.active()
    bundle, bindings, services = coerce_sources(sources), coerce_bindings(extractors), dict(services or {})
    own_fallback = on_missing_binding == SCHEMA_AS_EXTRACTOR and schema_as_extractor is None
    fallback = (schema_as_extractor or language_model.schema_as_extractor) if on_missing_binding == SCHEMA_AS_EXTRACTOR else None
    plan = join(graph_spec, bindings, fallback)
    if plan.unbound and on_missing_binding == ERROR:
        raise ValueError(f"no strategy is bound to {list(plan.unbound)}")
    if own_fallback and "llm" not in services and (open_elements := routed(plan)):
        raise ValueError(f"{open_elements} have no binding and need a client as the service 'llm'; bind them, give services={{'llm': client}}, or pass on_missing_binding='skip'")
    read = Counter(s for step in plan.steps if isinstance(s := getattr(step.extractor, "source", None), str))
    bundle.share(s for s, n in read.items() if n > 1)
    nodes: list[DataFrame] = [spark.createDataFrame([], STAGED_NODES)]
    edges: list[DataFrame] = [spark.createDataFrame([], STAGED_EDGES)]
    for k, step in enumerate(plan.steps):
        one = step.element_types[0] if len(step.element_types) == 1 else None
        context = ExtractionContext(spark, bundle, graph_spec, one, step.element_types, services, cache or NullCache())
        own_nodes, own_edges = step.extractor(context).staged(spark, k)
        nodes += own_nodes
        edges += own_edges
    union = lambda frames: reduce(DataFrame.unionByName, frames[1:] or frames)
    # every step runs once; merging, checks and reports read its rows, not the sources
    staged = [stored(union(frames), "staged") for frames in (nodes, edges)]
    graph = assemble(*staged, reports={"unbound_elements": list(plan.unbound)})
    if resolve is not None:
        unbound = graph.reports["unbound_elements"]
        graph = resolve_graph(graph, resolve)
        graph.reports["unbound_elements"] = unbound
    return graph
