"""From places in sources to elements, and anchors that moved."""

from __future__ import annotations

import difflib
from collections.abc import Iterator


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..evidence import TextPositionSelector, TextQuoteSelector

#: Width of the buckets by which spans and probes meet, in code points.
BUCKET = 4096


class TraceIndex:
    """Grounding of an evidence table by source: spans, cells and pages."""

    def __init__(self, evidence: DataFrame) -> None:
        g = evidence.select("element_id", "attribute", F.explode("evidence.grounding").alias("g")).select("element_id", "attribute", "g.*")
        source = F.coalesce("source_id", F.lit("?")).alias("source_id")
        self.spans = g.where("kind = 'TextPositionSelector'").select("element_id", "attribute", source, "start", "end")
        self.cells = g.where("kind = 'CellSelector'").select("element_id", "attribute", source, "row", "column")
        self.pages = g.where("kind = 'PageSelector'").select("element_id", "attribute", source, "page")

    def at(self, probes: DataFrame) -> DataFrame:
        """Elements whose span holds the offset of each ``source_id, offset``."""
        return spans_at(self.spans, probes)

    def overlapping(self, probes: DataFrame) -> DataFrame:
        """Elements whose span overlaps ``[from, to)`` of each ``source_id, from, to``."""
        return spans_overlapping(self.spans, probes)

    def in_cell(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.cells, ["source_id", "row", "column"])

    def on_page(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.pages, ["source_id", "page"])


def _buckets(start, end):
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(F.greatest(start, end - 1) / BUCKET)))


def spans_at(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Spans ``source_id, start, end`` and probes ``source_id, offset``, met by source and bucket."""
    cut = spans.withColumn("_b", _buckets(F.col("start"), F.col("end")))
    placed = probes.withColumn("_b", F.floor(F.col("offset") / BUCKET))
    return placed.join(cut, ["source_id", "_b"]).where("start <= offset and offset < end").drop("_b")


def spans_overlapping(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Spans that share a place with a probe's ``[from, to)``; a pair is kept in the first bucket they share."""
    cut = spans.withColumn("_b", _buckets(F.col("start"), F.col("end")))
    placed = probes.withColumn("_b", _buckets(F.col("from"), F.col("to")))
    first = F.floor(F.greatest("start", "from") / BUCKET) == F.col("_b")
    return placed.join(cut, ["source_id", "_b"]).where(first & F.expr("start < to and from < end")).drop("_b")


def verify_anchor(selector: TextQuoteSelector, text: str) -> bool:
    """Whether the quote is in the text as it was; an empty one is lost."""
    return bool(selector.exact) and selector.exact in text


#: From this length on, the fuzzy search leaves common characters of the quote out of account, as ``difflib`` does.
LONG_QUOTE = 200


def longest_block(text: str, quote: str) -> tuple[int, int]:
    """Start in the text and size of the longest run of characters that the quote has too; of equal ones the first.

    The text streams once through a suffix automaton of the quote, so its length
    costs in proportion. Quotes of ``LONG_QUOTE`` characters go to ``difflib``, whose
    shortcut for common characters is part of the result there.
    """
    if len(quote) >= LONG_QUOTE:
        block = difflib.SequenceMatcher(None, text, quote).find_longest_match()
        return block.a, block.size
    after: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in quote:
        new = len(after)
        after.append({})
        link.append(0)
        size.append(size[last] + 1)
        at, last = last, new
        while at >= 0 and c not in after[at]:
            after[at][c] = new
            at = link[at]
        if at < 0:
            continue
        there = after[at][c]
        if size[there] > size[at] + 1:  # longer than what leads to it here: a copy stands for the shorter ones
            after.append(dict(after[there]))
            link.append(link[there])
            size.append(size[at] + 1)
            link[there] = copy = len(after) - 1
            while at >= 0 and after[at].get(c) == there:
                after[at][c] = copy
                at = link[at]
            there = copy
        link[new] = there
    best, end, state, n = 0, 0, 0, 0
    for k, c in enumerate(text, 1):
        while state and c not in after[state]:
            state = link[state]
            n = size[state]
        if c in after[state]:
            state, n = after[state][c], n + 1
            if n > best:
                best, end = n, k
        else:
            n = 0
    return end - best, best


def reanchor(selector: TextQuoteSelector, text: str, hint: int | None = None, fuzzy: bool = True) -> TextPositionSelector | None:
    """Where a quote is now.

    A single exact occurrence wins. Among several, one whose surroundings fit
    the prefix and the suffix, then one near the hint, then the first. Without
    any, the longest common block counts if it has three characters and six
    tenths of the quote.
    """
    quote = selector.exact
    if not quote:
        return None
    starts, k = [], text.find(quote)
    while k >= 0:
        starts.append(k)
        k = text.find(quote, k + len(quote))
    if starts:

        def fit(start: int) -> float:
            end = start + len(quote)
            before = bool(selector.prefix) and text[:start].endswith(selector.prefix)
            behind = bool(selector.suffix) and text[end:].startswith(selector.suffix)
            return before + behind - (1e-6 * abs(start - hint) if hint is not None else 0)

        start = starts[0] if len(starts) == 1 else max(starts, key=fit)
        return TextPositionSelector(start, start + len(quote))
    if fuzzy:
        start, size = longest_block(text, quote)
        if size >= max(3, int(0.6 * len(quote))):
            return TextPositionSelector(start, start + size)
    return None


def reanchored(rows: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``start`` and ``end`` (null: lost) for rows of ``exact, prefix, suffix, text, hint``.

    Quotes that occur once are found without Python.
    """
    at = F.expr("instr(text, exact)")
    again = F.expr("locate(exact, text, instr(text, exact) + 1)")
    once = rows.where((F.length("exact") > 0) & (at > 0) & (again == 0)).select("*", (at - 1).cast("long").alias("start"), (at - 1 + F.length("exact")).cast("long").alias("end"))
    rest = rows.where(~F.coalesce((F.length("exact") > 0) & (at > 0) & (again == 0), F.lit(False)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for e, p, s, t, h in zip(part["exact"], part["prefix"], part["suffix"], part["text"], part["hint"], strict=True):
                found = reanchor(TextQuoteSelector(e or "", p or "", s or ""), t or "", None if h is None or h != h else int(h), fuzzy)
                out.append((found.start, found.end) if found else (None, None))
            yield part.assign(start=pd.array([a for a, _ in out], "Int64"), end=pd.array([b for _, b in out], "Int64"))

    return once.unionByName(rest.mapInPandas(run, f"{kinds}, start long, end long"))
