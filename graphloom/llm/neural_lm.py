"""A log-bilinear language model, trained with noise-contrastive estimation, that scores texts.

The model predicts units: each of the ``WORDS`` most frequent training words, the
``ENDINGS`` most frequent last bytes of all other words, one unit for what is
left, and the end of a text. Two preceding units are mapped by a matrix each and
added; the product with a unit's vector plus its bias is its score. A word
without a unit of its own then has its share of its unit's training tokens, one
token more for each word and one for words never seen, so probabilities add up
to 1 over all words and the end. These counts are of the whole training part.

A score is a sum of one term for each preceding unit, so the normalisers of all
pairs of preceding units are one matrix product of exponentials, and the
log-probabilities of a batch are read from three small tables.

Training goes over all training texts in ``ROUNDS`` disjoint parts. In a round
each task goes on from the last parameters with its own texts, and their mean,
weighted by tokens, starts the next round. Means are taken by position in Spark,
so the driver holds one set of parameters, whatever the number of tasks.

Words are counted once for the corpus. Counts of the ``HEAD`` most common ones
are sent to the tasks; all others are joined to the documents' frequencies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, stored, utf8

#: Words and endings with a unit of their own, and bytes of an ending.
WORDS, ENDINGS, LAST = 1_024, 256, 3
#: Common words whose counts are sent to tasks, of at most so many bytes.
HEAD, HEAD_BYTES = 200_000, 64
#: Size of vectors, rounds of training, tokens of a step, noise units of a step, rate of the steps.
SIZE, ROUNDS, STEP, NOISE, RATE = 16, 4, 1_024, 32, 0.03
#: Words counted in a task before they are handed on.
FLUSH = 400_000


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than blanks, tabs and line breaks, with A-Z lower-cased."""
    return text.lower().split()


# counts -----------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return made

    for batch in batches:
        for text in utf8(batch.column(0)):
            seen.update(words(text))
            if len(seen) > FLUSH:
                yield flush()
    yield flush()


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` of all texts."""
    return texts.select(F.col(text)).mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """Which unit a word belongs to, what is known of the head's words, and each unit's training tokens.

    ``share`` is log10 of what a unit's tokens, words and unseen words come to: 0 for
    units of one word.
    """

    def __init__(self, top: list[tuple[bytes, int]], endings: list[bytes], sums: dict[bytes | None, tuple[int, int]], head: dict[bytes, int], texts: int) -> None:
        self.single = {w: k for k, (w, _) in enumerate(top)}
        self.ending = {e: len(top) + k for k, e in enumerate(endings)}
        self.rest = len(top) + len(endings)
        self.end = self.rest + 1
        self.n = self.end + 1
        self.tokens = np.zeros(self.n, np.int64)
        self.share = np.zeros(self.n)
        self.tokens[: len(top)] = [n for _, n in top]
        self.tokens[self.end] = texts
        for e, k in [*self.ending.items(), (None, self.rest)]:
            n, distinct = sums.get(e, (0, 0))
            self.tokens[k], self.share[k] = n, math.log10(n + distinct + 1)
        known = dict(top) | head
        self.code = {w: k for k, w in enumerate(known)}
        self.known = np.log10(np.fromiter(known.values(), np.float64, len(known)) + 1)
        self.of_code = np.fromiter(map(self.of, known), np.int64, len(known))

    def of(self, word: bytes) -> int:
        own = self.single.get(word)
        return own if own is not None else self.ending.get(word[-LAST:], self.rest)


def units(counts: DataFrame, texts: int, head: int = HEAD, n_words: int = WORDS, n_endings: int = ENDINGS) -> Units:
    """Units from ``word, n`` of the training part, which is read several times."""
    top = [(bytes(r["word"]), r["n"]) for r in counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(n_words).collect()]
    others = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w, _ in top], "word binary")), "word", "left_anti") if top else counts
    ending = F.expr(f"substring(word, -{LAST}, {LAST})")
    by_ending = stored(others.groupBy(F.when(F.octet_length("word") < LAST, F.col("word")).otherwise(ending).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct")), "endings")
    most = by_ending.orderBy(F.desc("n"), "ending").limit(n_endings).collect()
    sums: dict[bytes | None, tuple[int, int]] = {bytes(r["ending"]): (r["n"], r["distinct"]) for r in most}
    whole = by_ending.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    sums[None] = tuple(w - sum(x[k] for x in sums.values()) for k, w in enumerate(whole))
    return Units(top, [e for e in sums if e is not None], sums, _head(counts, head), texts)


def _head(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the most common words, at most ``most``: whole levels of the logarithm of their count."""
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    left, least = most, None
    for r in short.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred levels at most
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return {}
    got = short.where(F.col("level") >= least).select("word", "n").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


# texts as units ---------------------------------------------------------------

CODED = "row long, id long, held_out boolean, learn boolean, n_tokens long, n_known long, known double, own double, units array<short>, rare array<binary>, times array<int>"


def _coded(sent) -> Callable:
    """Texts as units; ``known`` sums log10(n + 1) of the head's words and the end, ``own`` what a word has in its unit.

    Words beyond the head are listed with how often they come, for the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Units = sent.value
        numbers, code, of = RowNumbers(), held.code, held.of
        known, unit_of = np.append(held.known, 0.0), np.append(held.of_code, -1)
        end_known = math.log10(held.tokens[held.end] + 1)
        for batch in batches:
            rows: list[tuple] = []
            for text in utf8(batch.column(0)):
                own = words(text)
                codes = np.fromiter((code.get(w, -1) for w in own), np.int64, len(own))
                unit, seen = unit_of[codes], known[codes]
                at = np.flatnonzero(codes < 0)
                rare = Counter(own[k] for k in at.tolist())
                if len(at):
                    unit[at] = [of(own[k]) for k in at.tolist()]
                shared = seen[unit >= len(held.single)].sum() - held.share[unit].sum()
                rows.append((len(own) + 1, len(own) - len(at) + bool(held.tokens[held.end]), float(seen.sum()) + end_known, float(shared), np.append(unit, held.end).astype(np.int16), list(rare), list(rare.values())))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int16()), pa.list_(pa.binary()), pa.list_(pa.int32())]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers.take(len(rows)), pa.int64()), batch.column(1), batch.column(2), batch.column(3), *made], ["row", "id", "held_out", "learn", "n_tokens", "n_known", "known", "own", "units", "rare", "times"])

    return run


# the model --------------------------------------------------------------------


class Model:
    """Parameters of the log-bilinear model; the context ``n`` stands for what is before a text."""

    def __init__(self, tokens: np.ndarray, size: int = SIZE, seed: int = 7) -> None:
        draw, n = np.random.default_rng(seed), len(tokens)
        self.noise = (tokens + 1) / (tokens + 1).sum()
        self.parts = [
            draw.normal(0, 0.1, (n + 1, size)).astype(np.float32),  # vectors of preceding units
            np.eye(size, dtype=np.float32),  # map of the last unit
            np.eye(size, dtype=np.float32) / 2,  # map of the one before it
            draw.normal(0, 0.1, (n, size)).astype(np.float32),  # vectors of predicted units
            np.log(self.noise).astype(np.float32),  # biases: at first the units' frequencies
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def put(self, flat: np.ndarray) -> Model:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of a unit after a last unit (its bias included), after a unit before it, and log-normalisers of pairs."""
        before, last, first, after, bias = (p.astype(np.float64) for p in self.parts)
        one, two = before @ last @ after.T + bias, before @ first @ after.T
        top_one, top_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        z = np.log(np.exp(one - top_one) @ np.exp(two - top_two).T) + top_one + top_two.T
        return one, two, z


def contexts(own: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last unit and the one before it, for each unit of a text."""
    padded = np.concatenate(([start, start], own))
    return padded[1:-1], padded[:-2]


class Trainer:
    """Adagrad steps on the noise-contrastive objective; a step's tokens share their noise units."""

    def __init__(self, model: Model, rate: float = RATE, noise: int = NOISE, seed: int = 0) -> None:
        self.model, self.rate, self.n_noise = model, rate, noise
        self.draw = np.random.default_rng(seed)
        self.sums = [np.full(p.shape, 1e-2, np.float32) for p in model.parts]
        self.below = np.cumsum(model.noise)
        self.log_noise = (np.log(model.noise) + math.log(noise)).astype(np.float32)

    def step(self, last: np.ndarray, first: np.ndarray, unit: np.ndarray) -> None:
        before, by_last, by_first, after, bias = self.model.parts
        noise = np.minimum(np.searchsorted(self.below, self.draw.random(self.n_noise)), len(bias) - 1)
        x, y, wanted, other = before[last], before[first], after[unit], after[noise]
        q = x @ by_last + y @ by_first
        sure = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        right = 1 - sure((q * wanted).sum(axis=1) + bias[unit] - self.log_noise[unit])
        wrong = -sure(q @ other.T + bias[noise] - self.log_noise[noise])
        dq = right[:, None] * wanted + wrong @ other
        self._add(1, x.T @ dq)
        self._add(2, y.T @ dq)
        self._rows(3, np.concatenate([unit, noise]), np.concatenate([right[:, None] * q, wrong.T @ q]))
        self._rows(4, np.concatenate([unit, noise]), np.concatenate([right, wrong.sum(axis=0)]))
        self._rows(0, np.concatenate([last, first]), np.concatenate([dq @ by_last.T, dq @ by_first.T]))

    def _rows(self, k: int, at: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        self._add(k, np.add.reduceat(rows[order], first, axis=0), own[first])

    def _add(self, k: int, gradient: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        sums = self.sums[k][at] + gradient * gradient
        self.sums[k][at] = sums
        self.model.parts[k][at] += self.rate * gradient / np.sqrt(sums)


def _trained(tokens: np.ndarray, flat: np.ndarray) -> Callable:
    """Go on from ``flat`` with a task's texts; gives tokens and parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(tokens).put(flat)
        trainer = Trainer(model, seed=RowNumbers().partition)
        seen, start = 0, len(tokens)
        for batch in batches:
            lists = batch.column(0)
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            # two starts before each text, so that all texts of the batch are one array
            at = np.arange(len(own)) + 2 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
            padded = np.full(len(own) + 2 * len(sizes), start)
            padded[at] = own
            at = trainer.draw.permutation(at)
            for k in range(0, len(at), STEP):
                now = at[k : k + STEP]
                trainer.step(padded[now - 1], padded[now - 2], padded[now])
            seen += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.flat()], pa.list_(pa.float32()))], ["seen", "flat"])

    return run


def train(coded: DataFrame, tokens: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of the ``units`` of all rows that may be learned from; each is used once."""
    model = Model(tokens)
    for r in range(rounds):
        part = coded.where(F.col("learn") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)).select("units")
        found = part.mapInArrow(_trained(tokens, model.flat()), "seen long, flat array<float>").where("seen > 0")
        mean = found.select("seen", F.posexplode("flat").alias("at", "value")).groupBy("at").agg((F.sum(F.col("seen") * F.col("value")) / F.sum("seen")).alias("value")).toArrow()  # one row a parameter
        if len(mean):
            flat = np.empty(len(mean))
            flat[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
            model.put(flat)
    return model


def _scored(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, z = sent.value.tables()
        for batch in batches:
            scores = []
            for own in batch.column(1):
                unit = own.values.to_numpy(zero_copy_only=False).astype(np.int64)
                last, first = contexts(unit, len(one) - 1)
                scores.append(float((one[last, unit] + two[first, unit] - z[last, first]).sum()) / math.log(10))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "model"])

    return run


# ------------------------------------------------------------------------------


def scores(docs: DataFrame, learn, held_out, id_column: str = "doc_id", text: str = "text", head: int = HEAD, n_words: int = WORDS, n_endings: int = ENDINGS, rounds: int = ROUNDS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``learn`` and ``held_out`` are conditions on a row; a null condition is false.
    Scores are log10 probabilities: ``base_score`` by word frequencies with one
    added, ``score`` by the model. The end of a text is a token. A null or empty
    text is its end alone. Repeated rows, repeated and null ids each keep a row of
    their own. Without anything to learn from, ``base_score`` is 0 and ``score``
    that of the untrained model. Other columns are not read. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = docs.select(F.col(text).alias("text"), F.col(id_column).cast("long").alias("id"), yes(held_out).alias("held_out"), yes(learn).alias("learn"))
    counts = stored(word_counts(own.where("learn")), "words")
    texts = own.where("learn").count()
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = distinct + bool(texts), total + texts
    known = units(counts, texts, head, n_words, n_endings)
    coded = stored(own.mapInArrow(_coded(spark.sparkContext.broadcast(known)), CODED), "coded")
    model = train(coded, known.tokens, rounds)
    by_model = coded.select("row", "units").mapInArrow(_scored(spark.sparkContext.broadcast(model)), "row long, model double")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("known_more"))
    more = lambda name: F.coalesce(name, F.lit(0))
    return coded.drop("units", "rare", "times").join(by_model, "row").join(found, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known") + more("known_more") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("own") + more("known_more")).alias("score"),
    )
