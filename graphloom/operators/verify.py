"""Scored comparison of actual and expected values and graphs.

Each value verifier is a rule in two forms: ``column`` scores two columns of
JSON texts in a plan, and a call scores two values on the driver.
"""

from __future__ import annotations

import difflib
import json
import math
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_value, normalized, normalized_text, same_value, sequence_ratio
from ..graph import Graph
from ..spec import GraphSpec, effective_attributes
from .batches import starts, whole_keys
from .context import Registry
from .validation import validation_issues


@dataclass(frozen=True)
class Verdict:
    score: float
    passed: bool
    reason: str = ""
    details: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "score", min(1.0, max(0.0, float(self.score))))

    def to_dict(self) -> dict[str, Any]:
        return {"score": self.score, "passed": self.passed, "reason": self.reason, "details": dict(self.details)}


@dataclass
class VerificationContext:
    spec: GraphSpec | None = None
    services: Mapping[str, Any] = field(default_factory=dict)


def passed_at(score: float, threshold: float) -> bool:
    return score >= threshold


verifiers = Registry("verifier", "graphloom.verifiers")
register_verifier, build_verifier, available_verifiers = verifiers.register, verifiers.build, verifiers.names


def _binary(equal: bool, reason: str) -> Verdict:
    return Verdict(1.0 if equal else 0.0, equal, reason)


@register_verifier("exact")
class ExactMatch:
    def column(self, actual: Column, expected: Column) -> Column:
        return F.when(same_value(actual, expected), 1.0).otherwise(0.0)

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        return _binary(actual == expected, f"{actual!r} and {expected!r}")


def norm(value: Any) -> Any:
    return normalized_text(value) if isinstance(value, str) else value


@register_verifier("normalized")
class NormalizedMatch:
    def column(self, actual: Column, expected: Column) -> Column:
        texts = actual.startswith('"') & expected.startswith('"')
        return F.when(F.coalesce(texts & (normalized(json_value(actual)) == normalized(json_value(expected))), F.lit(False)) | same_value(actual, expected), 1.0).otherwise(0.0)

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        return _binary(norm(actual) == norm(expected), f"{norm(actual)!r} and {norm(expected)!r}")


@register_verifier("numeric_tolerance")
@dataclass
class NumericTolerance:
    abs_tol: float = 0.0
    rel_tol: float = 0.0

    def column(self, actual: Column, expected: Column) -> Column:
        plain = lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(F.trim(json_value(v)).try_cast("double"))
        return self.within(plain(actual), plain(expected))

    def within(self, a: Column, e: Column) -> Column:
        """For columns that are numbers already."""
        near = F.abs(a - e) <= F.greatest(F.lit(float(self.abs_tol)), F.lit(float(self.rel_tol)) * F.abs(e))
        return F.when(F.coalesce(near & ~F.isnan(a) & ~F.isnan(e), F.lit(False)), 1.0).otherwise(0.0)

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        try:
            a, e = float(actual), float(expected)
        except (TypeError, ValueError):
            return _binary(False, "not numbers")
        return _binary(abs(a - e) <= max(self.abs_tol, self.rel_tol * abs(e)), f"{a} and {e}")


def prf(true: float, actual: float, expected: float) -> dict[str, float]:
    """Precision, recall and F1; two empty sides agree."""
    p = true / actual if actual else 1.0 if not expected else 0.0
    r = true / expected if expected else 1.0 if not actual else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


@register_verifier("set_match")
@dataclass
class SetMatch:
    key: Callable[[Any], Any] | None = None
    threshold: float = 1.0

    def column(self, actual: Column, expected: Column) -> Column:
        """F1 of two array columns."""
        a, e = F.array_distinct(actual), F.array_distinct(expected)
        both = F.size(F.array_intersect(a, e))
        return F.when((F.size(a) == 0) & (F.size(e) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, (F.size(a) + F.size(e)).cast("double")), F.lit(0.0)))

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        key = self.key or (lambda v: v if isinstance(v, (str, int, float, bool, tuple, type(None))) else json.dumps(v, sort_keys=True, default=str))
        a, e = {key(x) for x in actual or ()}, {key(x) for x in expected or ()}
        scores = prf(len(a & e), len(a), len(e))
        return Verdict(scores["f1"], passed_at(scores["f1"], self.threshold), f"f1={scores['f1']:.3f}", scores | {"missing": sorted(map(str, e - a)), "extra": sorted(map(str, a - e))})


@register_verifier("schema_constraint")
@dataclass
class SchemaConstraint:
    """A graph's share of elements without issues, or a predicate on any value."""

    spec: GraphSpec | None = None
    predicate: Callable[[Any], bool] | None = None

    def __call__(self, actual: Any, expected: Any = None, *, context: VerificationContext | None = None) -> Verdict:
        if self.predicate is not None:
            return _binary(bool(self.predicate(actual)), "predicate")
        spec = self.spec or (context.spec if context else None)
        if spec is None or not isinstance(actual, Graph):
            raise ValueError("schema_constraint needs a graph and a grammar, or a predicate")
        n = validation_issues(actual, spec).count()
        size = actual.number_of_nodes() + actual.number_of_edges()
        return Verdict(max(0.0, 1 - n / max(1, size)), n == 0, f"{n} issues in {size} elements", {"issues": n})


@register_verifier("predicate")
def predicate_verifier(predicate: Callable[[Any], bool]) -> SchemaConstraint:
    return SchemaConstraint(predicate=predicate)


@register_verifier("semantic_similarity")
@dataclass
class SemanticSimilarity:
    """Cosine of an injected embedder's vectors, else lexical similarity, which is said in the details."""

    threshold: float = 0.8
    embedder: Callable[[str], Sequence[float]] | None = None

    def column(self, actual: Column, expected: Column) -> Column:
        return sequence_ratio(json_value(actual), json_value(expected))

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        embed = self.embedder or (context.services.get("embedder") if context else None)
        if embed:
            u, v = embed(str(actual)), embed(str(expected))
            norms = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
            score = sum(x * y for x, y in zip(u, v, strict=False)) / norms if norms else 0.0
        else:
            score = difflib.SequenceMatcher(None, str(actual), str(expected)).ratio()
        return Verdict(score, passed_at(score, self.threshold), f"similarity={score:.3f}", {"lexical": not embed})


@register_verifier("composite")
@dataclass
class Composite:
    """Weighted mean of verifiers, given as ``(verifier, weight)``."""

    components: Sequence[tuple[Any, float]] = ()
    threshold: float = 0.5

    def column(self, actual: Column, expected: Column) -> Column:
        total = sum(w for _, w in self.components) or 1.0
        out = F.lit(0.0)
        for v, w in self.components:
            out = out + F.lit(float(w)) * v.column(actual, expected)
        return out / F.lit(float(total))

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        parts = [(v(actual, expected, context=context), w) for v, w in self.components]
        score = sum(x.score * w for x, w in parts) / (sum(w for _, w in parts) or 1.0)
        return Verdict(score, passed_at(score, self.threshold), f"composite={score:.3f}", {"parts": [x.to_dict() for x, _ in parts]})


def expand_json_object(text: str) -> str | None:
    """The first balanced JSON object in a text, quotes and escapes respected."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for k, c in enumerate(text[start:], start):
            if escaped:
                escaped = False
            elif c == "\\" and quoted:
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    return text[start : k + 1]
        start = text.find("{", start + 1)
    return None


def parse_judgement(reply: Any) -> tuple[float, str]:
    """Score (0 to 1) and reason of a judge's reply, a mapping or a text with a JSON object."""
    if isinstance(reply, str):
        found = expand_json_object(reply)
        try:
            reply = json.loads(found) if found else None
        except ValueError:
            reply = None
    if not isinstance(reply, Mapping) or "score" not in reply:
        raise ValueError("the judge's reply has no score")
    try:
        return min(1.0, max(0.0, float(reply["score"]))), str(reply.get("reason", ""))
    except (TypeError, ValueError) as bad:
        raise ValueError(f"the judge's score {reply['score']!r} is no number") from bad


@register_verifier("llm_rubric")
@dataclass
class LLMRubric:
    """A judge scores the actual against the expected by a rubric."""

    rubric: str = ""
    judge: Callable[[str], Any] | None = None
    threshold: float = 0.5

    def prompt(self, actual: Any, expected: Any) -> str:
        shown = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)
        return f'Rubric:\n{self.rubric}\n\nExpected:\n{shown(expected)}\n\nActual:\n{shown(actual)}\n\nAnswer with JSON: {{"score": 0 to 1, "reason": "..."}}'

    def __call__(self, actual: Any, expected: Any, *, context: VerificationContext | None = None) -> Verdict:
        judge = self.judge or (context.services.get("judge") if context else None)
        if judge is None:
            raise ValueError("llm_rubric needs a judge, given or as the service 'judge'")
        score, reason = parse_judgement(judge(self.prompt(actual, expected)))
        return Verdict(score, passed_at(score, self.threshold), reason)


def schema_description_verifier(spec: GraphSpec, type: str, attribute: str, judge: Callable[[str], Any] | None = None, threshold: float = 0.5) -> LLMRubric:
    """A rubric out of an attribute's description."""
    attr = effective_attributes(spec, type)[attribute]
    return LLMRubric(f"{type}.{attribute}: {attr.description or attribute}. Both values should mean the same.", judge, threshold)


# graphs ------------------------------------------------------------------------


def node_sets(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ``n_both, n_actual, n_expected`` over distinct ids."""
    a, e = actual.select("id").distinct().withColumn("a", F.lit(1)), expected.select("id").distinct().withColumn("e", F.lit(1))
    return a.join(e, "id", "full").agg(*(F.coalesce(F.sum(F.coalesce(x, F.lit(0))), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("a") * F.col("e"), "n_both"), (F.col("a"), "n_actual"), (F.col("e"), "n_expected"))))


def edge_bags(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ``n_both, n_actual, n_expected`` over edges as a bag of (type, source, target)."""
    key = ["type", "source", "target"]
    a, e = actual.groupBy(*key).agg(F.count("*").alias("a")), expected.groupBy(*key).agg(F.count("*").alias("e"))
    met = a.join(e, key, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("e", F.lit(0)).alias("e"))
    return met.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.least("a", "e"), "n_both"), (F.col("a"), "n_actual"), (F.col("e"), "n_expected"))))


#: Attributes of an edge up to which its partners are looked up by sets of names; wider ones are compared one by one.
WIDE = 10


def partners(actual: Sequence[Mapping[str, str]], expected: Sequence[Mapping[str, str]]) -> Iterator[tuple[int, int]]:
    """Pairs (expected, actual) of parallel edges: most equal attributes first, then by place of the expected one, then of the actual one.

    Goes down by the number of equal attributes. At each level no two edges that are
    left agree in more, so those that agree in as many names are found by hashing
    them: an expected edge looks up its values under each set of names of that size
    and takes the first actual edge. Memory and, for edges that are not wide, time
    grow with the number of edges, not with that of pairs.
    """
    waiting, free = list(range(len(expected))), bytearray(b"\1") * len(actual)
    for level in range(max(map(len, expected), default=0), 0, -1):
        known: dict[tuple[str, ...], dict[tuple, deque[int]]] = {}

        def offers(names: tuple[str, ...], known=known) -> dict[tuple, deque[int]]:
            if names not in known:
                made = known[names] = defaultdict(deque)
                for i, own in enumerate(actual):
                    if free[i] and all(n in own for n in names):
                        made[tuple(own[n] for n in names)].append(i)
            return known[names]

        def first(wanted: Mapping[str, str], level=level, offers=offers) -> int | None:
            if len(wanted) > WIDE:
                return next((i for i, own in enumerate(actual) if free[i] and sum(own.get(n) == v for n, v in wanted.items()) == level), None)
            found = []
            for names in combinations(sorted(wanted), level):
                queue = offers(names).get(tuple(wanted[n] for n in names))
                while queue and not free[queue[0]]:
                    queue.popleft()
                if queue:
                    found.append(queue[0])
            return min(found, default=None)

        still = []
        for j in waiting:
            i = first(expected[j]) if len(expected[j]) >= level else None
            if i is None:
                still.append(j)
            else:
                free[i] = 0
                yield j, i
        waiting = still
    yield from zip(waiting, (i for i in range(len(actual)) if free[i]), strict=False)


#: What edges must share to be parallel.
KEY = ["type", "source", "target"]


def _in_turn(rows: np.ndarray, group: np.ndarray, code: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides, the k-th actual and the k-th expected one of each group and code."""
    order = np.lexsort((rows, side, code, group))
    g, c, s = group[order], code[order], side[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    turn = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.lexsort((s, turn, c, g))
    order, g, c, s, turn = order[again], g[again], c[again], s[again], turn[again]
    met = np.flatnonzero((g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (turn[1:] == turn[:-1]) & (s[1:] != s[:-1]))
    return rows[order[met]], rows[order[met + 1]]


def _partnered(rows: pa.Table) -> pa.Table:
    """The pairs of whole keys' edges, which are in the order of key, side and id.

    Keys whose edges have one attribute at most, and those with one edge on either
    side, are paired all at once; the others one by one.
    """
    group = np.cumsum(starts(rows, KEY)) - 1
    side = rows.column("side").to_numpy().astype(np.int64)
    maps = rows.column("attributes").combine_chunks()
    offsets = maps.offsets.to_numpy()  # into all keys and items, also where rows are a slice
    n = np.where(maps.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    n_actual, n_expected = (np.bincount(group, weights=side == k, minlength=group[-1] + 1).astype(np.int64) for k in (0, 1))
    sole = (n_actual == 1) & (n_expected == 1)
    thin = np.bincount(group, weights=n > 1, minlength=len(sole)) == 0
    everyone, live = np.arange(len(group)), (n_actual > 0) & (n_expected > 0)
    at = np.flatnonzero(n == 1)
    names, values = (f.take(pa.array(offsets[at])).dictionary_encode(null_encoding="encode") for f in (maps.keys, maps.items))
    one = np.zeros(len(group), dtype=np.int64)  # the attribute of an edge that has one
    one[at] = names.indices.to_numpy() * np.int64(len(values.dictionary)) + values.indices.to_numpy()
    found = []
    left = (live & thin & ~sole)[group]
    pick = everyone[left & (n == 1)]
    found.append(_in_turn(pick, group[pick], one[pick], side[pick]))
    left[np.concatenate(found[0])] = False
    pick = everyone[left | (live & sole)[group]]
    found.append(_in_turn(pick, group[pick], np.zeros(len(pick), dtype=np.int64), side[pick]))
    bounds = np.searchsorted(group, np.arange(len(sole) + 1))
    for k in np.flatnonzero(live & ~thin & ~sole):
        low, high = bounds[k], bounds[k + 1]
        own = [dict(x or ()) for x in maps.slice(low, high - low).to_pylist()]
        middle = int(n_actual[k])
        met = np.array([(low + i, low + middle + j) for j, i in partners(own[:middle], own[middle:])], dtype=np.int64).reshape(-1, 2)
        found.append((met[:, 0], met[:, 1]))
    a, e = (pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1))
    return pa.table({"type": rows.column("type").take(e), "actual": maps.take(a), "expected": maps.take(e)})


def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``type, actual, expected`` of the pairs of parallel edges, from edges in the order of key, side (0: actual) and id; holds a batch or a key."""
    for rows in whole_keys(batches, KEY):
        yield from _partnered(rows).combine_chunks().to_batches()


@register_verifier("graph_match")
@dataclass
class GraphMatch:
    """Node F1, edge F1 and the mean score of attributes, blended; what measures nothing does not count."""

    spec: GraphSpec | None = None
    attribute_verifiers: Mapping[Any, Any] = field(default_factory=dict)
    node_weight: float = 1.0
    edge_weight: float = 1.0
    attr_weight: float = 1.0
    threshold: float = 0.8

    def chosen(self, spec: GraphSpec | None, type: str, attribute: str) -> Any:
        found = self.attribute_verifiers.get((type, attribute)) or self.attribute_verifiers.get(attribute)
        if found:
            return found
        attr = effective_attributes(spec, type).get(attribute) if spec else None
        return NumericTolerance() if attr and attr.range in ("integer", "decimal", "float") else NormalizedMatch()

    def attribute_rows(self, actual: Graph, expected: Graph) -> DataFrame:
        """``type, attribute, actual, expected`` for each attribute that matched elements should have."""
        nodes = expected.nodes.select("id", F.get("types", F.lit(0)).alias("type"), F.col("attributes").alias("e")).join(actual.nodes.select("id", F.col("attributes").alias("a")), "id")
        side = lambda graph, k: graph.edges.select(*KEY, F.lit(k).alias("side"), "id", "attributes")
        ordered = side(actual, 0).unionByName(side(expected, 1)).repartition(*KEY).sortWithinPartitions(*KEY, "side", F.asc_nulls_last("id"))
        met = ordered.drop("id").mapInArrow(paired, "type string, actual map<string,string>, expected map<string,string>")
        pairs = nodes.select("type", "a", "e").unionByName(met.select("type", F.col("actual").alias("a"), F.col("expected").alias("e")))
        return pairs.select("type", "a", F.explode("e").alias("attribute", "expected")).select("type", "attribute", F.col("a")[F.col("attribute")].alias("actual"), "expected")

    def attribute_score(self, actual: Graph, expected: Graph, spec: GraphSpec | None, context: VerificationContext | None) -> tuple[float, int]:
        rows = self.attribute_rows(actual, expected)
        total, n = 0.0, 0
        kinds = [(r["type"], r["attribute"]) for r in rows.select("type", "attribute").distinct().collect()]  # grammar-sized
        score = None
        for type, attribute in kinds:
            rule = self.chosen(spec, type, attribute)
            here = F.col("type").eqNullSafe(type) & F.col("attribute").eqNullSafe(attribute)
            if hasattr(rule, "column"):
                value = F.when(F.col("actual").isNull(), 0.0).otherwise(rule.column(F.col("actual"), F.col("expected")))
                score = (F.when if score is None else score.when)(here, value)
            else:  # a rule that only the driver can apply
                for r in rows.where(here).toLocalIterator():
                    n += 1
                    total += 0.0 if r["actual"] is None else rule(json.loads(r["actual"]), json.loads(r["expected"]), context=context).score
        if score is not None:
            r = rows.agg(F.sum(score).alias("s"), F.count(score).alias("n")).first()
            total, n = total + (r["s"] or 0.0), n + r["n"]
        return (total / n if n else 1.0), n

    def __call__(self, actual: Graph, expected: Graph, *, context: VerificationContext | None = None) -> Verdict:
        spec = self.spec or (context.spec if context else None)
        nodes, edges = node_sets(actual.nodes, expected.nodes).first(), edge_bags(actual.edges, expected.edges).first()
        attributes, compared = self.attribute_score(actual, expected, spec, context)
        node_prf, edge_prf = (prf(r["n_both"], r["n_actual"], r["n_expected"]) for r in (nodes, edges))
        parts = [
            (self.node_weight, node_prf["f1"], nodes["n_actual"] + nodes["n_expected"]),
            (self.edge_weight, edge_prf["f1"], edges["n_actual"] + edges["n_expected"]),
            (self.attr_weight, attributes, compared),
        ]
        told = [(w, s) for w, s, n in parts if n]
        score = sum(w * s for w, s in told) / (sum(w for w, _ in told) or 1.0) if told else 1.0
        return Verdict(score, passed_at(score, self.threshold), f"graph match {score:.3f}", {"nodes": node_prf, "edges": edge_prf, "attributes": {"score": attributes, "compared": compared}})


def greedy_pairs(a: Sequence[Mapping], e: Sequence[Mapping]) -> Counter:
    """How many attributes agree over the pairs of parallel edges; for tests and small graphs."""
    return Counter(sum(a[i].get(k) == v for k, v in e[j].items()) for j, i in partners(a, e))


def rubric_scores(rows: DataFrame, judge_factory: Callable[[], Callable[[str], Any]], rubric: str, actual: str, expected: str) -> DataFrame:
    """Judge scores of two text columns, on the executors; the factory makes one judge for each task."""
    rule = LLMRubric(rubric)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = judge_factory()
        for part in batches:
            got = [parse_judgement(judge(rule.prompt(a, e))) for a, e in zip(part[actual], part[expected], strict=True)]
            yield part.assign(score=[s for s, _ in got], reason=[r for _, r in got])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, score double, reason string")
