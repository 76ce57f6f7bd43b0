"""Language identification by rank-order n-gram profiles.

A profile is a list of n-grams, most frequent first. A document's profile is
compared to each language's by out-of-place distance: how far each of its
n-grams is from its place in the language's list, and the list's length for
n-grams that the list lacks. The nearest language wins.

Words are runs of letters, lower-cased and padded. A text's n-grams are counted
as numbers in one sorted array.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import dropped, fresh, kept, stored, tidied

SIZES = (1, 2, 3)
#: N-grams of a language profile, and of a document's.
PROFILE, OWN = 400, 300
#: A text fits a language if its score is at least this share of the median score of all documents that may be learned from and are put to it.
FIT = 0.5
#: Medians are taken of scores rounded down to one in so many.
STEPS = 10_000
#: Characters that are counted at once, and n-grams that a table of counts may have.
BLOCK, DENSE = 1 << 20, 4 << 20
#: N-grams that a worker remembers, and words of a text that are gone through together.
MEMO, TOGETHER = 200_000, 200_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LETTER = r"\p{L}"


def word_grams(word: str) -> list[str]:
    padded = f"_{word}_"
    longer = (padded[i : i + n] for n in SIZES[1:] for i in range(len(padded) - n + 1))
    return [*word, *longer]


def gram_counts(text: str) -> Counter:
    """N-grams of a text with their counts."""
    out: Counter = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        for gram in word_grams(word):
            out[gram] += n
    return out


def code(gram: str) -> int:
    """A number that stands for the n-gram and orders ties."""
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


def counts_together(texts: list[str]) -> dict[str, int]:
    """N-grams of all the texts with their counts.

    Letters that occur are numbered, all else is 0, so an n-gram is a number of
    up to three digits; few letters are counted in a table, more by sorting.
    """
    own = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = [c for c in np.flatnonzero(np.bincount(own)).tolist() if LETTERS.match(chr(c))]
    if not letters:
        return {}
    number = np.zeros(int(own.max()) + 1, np.int32)
    number[letters] = np.arange(1, len(letters) + 1)
    digits = np.concatenate(([0], number[own], [0, 0])).astype(np.int32)
    names, base, out = ["_", *map(chr, letters)], len(letters) + 1, Counter()
    for k in range(0, len(digits) - 2, BLOCK):
        one, two, three = (digits[k + i : k + i + BLOCK + min(0, len(digits) - 2 - k - BLOCK)].astype(np.int64) for i in range(3))
        for size, codes in zip(SIZES, (one[one > 0], (one * base + two)[one + two > 0], ((one * base + two) * base + three)[two > 0]), strict=True):
            if base**size <= DENSE:
                table = np.bincount(codes)
                found = np.flatnonzero(table)
                many = table[found]
            else:
                found, many = np.unique(codes, return_counts=True)
            for key, n in zip(found.tolist(), many.tolist(), strict=True):
                out["".join(names[key // base**i % base] for i in range(size - 1, -1, -1))] += n
    return out


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            grams = counts_together(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[str]]:
    """The profile of each language, from all rows with a text and a language."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    summed, path = kept(known.mapInArrow(tidied(_learned), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # at most ``size`` rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    dropped(labelled.sparkSession, path)
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams as numbers made of their code points, ascending, and their counts.

    Its words stand in one array with a mark between; n-grams across a mark are left out.
    """
    words = LETTERS.findall(text.lower())
    keys, counts = np.array([], np.uint64), np.array([], np.int64)
    for k in range(0, len(words), TOGETHER):
        own = np.frombuffer(f"_{'_'.join(words[k : k + TOGETHER])}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = own != ord("_")
        two = own[:-1] << np.uint64(21) | own[1:]
        three = (own[:-2] << np.uint64(42) | two[1:])[letter[1:-1]]
        found = np.sort(np.concatenate((own[letter], two, three)))
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        size = np.diff(np.append(first, len(found)))
        if len(words) <= TOGETHER:
            return found[first], size
        found, size = np.concatenate((keys, found[first])), np.concatenate((counts, size))
        order = np.argsort(found, kind="stable")
        found, size = found[order], size[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        keys, counts = found[first], np.add.reduceat(size, first)
    return keys, counts


def gram_of(key: int) -> str:
    """The n-gram of a number."""
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


class Profiles:
    """Language profiles as one table of places, by n-gram and language.

    Each n-gram that a worker meets among a text's most frequent ones gets the
    next row of the table. Rows are forgotten when they are many.
    """

    def __init__(self, profiles: dict[str, list[str]], own: int = OWN) -> None:
        self.langs, self.own = sorted(profiles), own
        self.size = max((len(p) for p in profiles.values()), default=1)
        self.place: dict[str, list[int]] = {}
        for j, k in enumerate(self.langs):
            for i, gram in enumerate(profiles[k]):
                self.place.setdefault(gram, [self.size] * len(self.langs))[j] = i
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.codes = np.zeros(1 << 12, np.uint32)
        self.places = np.full((1 << 12, len(self.langs)), self.size, np.int32)

    def _row(self, key: int) -> int:
        row, gram = len(self.rows), gram_of(key)
        if row >= len(self.codes):
            self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
            self.places = np.concatenate((self.places, np.full_like(self.places, self.size)))
        self.rows[key], self.codes[row] = row, code(gram)
        if gram in self.place:
            self.places[row] = self.place[gram]
        return row

    def top(self, text: str) -> np.ndarray:
        """Rows of the text's most frequent n-grams, in order; ties by code."""
        if len(self.rows) >= MEMO:
            self.forget()
        keys, counts = counted(text)
        if len(keys) > self.own:
            often = counts >= np.partition(counts, len(counts) - self.own)[len(counts) - self.own]
            keys, counts = keys[often], counts[often]
        known = self.rows.get
        rows = np.array([r if (r := known(k)) is not None else self._row(k) for k in keys.tolist()], np.int64)
        return rows[np.lexsort((self.codes[rows], -counts))[: self.own]]

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        top = self.top(text)
        there = self.places[top]
        apart = np.where(there == self.size, self.size, np.abs(there - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(top))


def _predicted(shared, lang: str = "lang_pred", score: str = "score", whole: bool = False) -> Callable:
    """Language and score behind a batch's columns; ``whole`` keeps the text among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            names = batch.schema.names
            got = [profiles.nearest(t) for t in batch.column(names.index("text")).to_pylist()]
            keep = [k for k, n in enumerate(names) if whole or n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*(names[k] for k in keep), lang, score])

        profiles.forget()  # a worker that waits for its next task keeps no rows

    return run


def identify(docs: DataFrame, profiles: dict[str, list[str]], keep: list[str], text: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` (1 is a perfect match) for every row, beside the columns in ``keep``.

    ``und`` with score 0 if the text is null or has no letter, or if no language
    was learned. Equal distances go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))
    chosen = docs.select(*keep, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInArrow(tidied(_predicted(shared)), f"{schema}, lang_pred string, score double")


def learning_part(id_column: str = "doc_id"):
    """Whether a row may be learned from; rows held out have remainder 2, null ids neither."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def bounds(scored: DataFrame, lang: str = "lang_pred", score: str = "score") -> dict[str, float]:
    """For each language, the least score with which a text is taken to be in it.

    It is ``FIT`` times the median of all rows put to the language, the lower
    one of two, counted in ``STEPS``, so it is the same however rows are split.
    """
    step = F.least(F.floor(F.col(score) * STEPS), F.lit(STEPS)).cast("int")
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in scored.where(F.col(lang) != UNKNOWN).groupBy(F.col(lang).alias("lang"), step.alias("step")).count().orderBy("lang", "step").collect():  # at most ``STEPS`` and one a language
        counts.setdefault(r["lang"], []).append((r["step"], r["count"]))
    out = {}
    for k, own in counts.items():
        below = np.cumsum([n for _, n in own])
        out[k] = FIT * own[int(np.searchsorted(2 * below, below[-1]))][0] / STEPS
    return out


def recognised(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised, columns unchanged; the others go.

    ``lang_pred`` and ``score`` decide: texts without letters and texts with a
    lower score than ``bounds`` has for their language go. If no profile could
    be learned, all documents with letters stay. Profiles and bounds come from
    all rows of the learning part that have a language; every row is scored
    once, and stored with its score.
    """
    known = docs.where(learning_part())
    profiles = learn(known)
    if not profiles:
        return docs.where(F.col("text").rlike(LETTER))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))
    named = stored(docs.mapInArrow(tidied(_predicted(shared, lang, score, whole=True)), StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])), "scored")
    least = F.create_map(*[x for k, v in bounds(named.where(learning_part() & F.col("lang").isNotNull()), lang, score).items() for x in (F.lit(k), F.lit(v))])
    return named.where((F.col(lang) != UNKNOWN) & (F.col(score) >= F.coalesce(least[F.col(lang)], F.lit(0.0)))).select(*docs.columns)
