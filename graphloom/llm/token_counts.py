"""Token counts without token ids.

A SentencePiece BPE model merges neighbouring symbols into pieces of its
vocabulary. Where no piece joins two neighbouring characters, no merge ever
crosses them, so a text falls into *pre-tokens* whose piece counts add up.

1. Every partition counts its pre-tokens; the sums over the corpus form the
   vocabulary table, and each distinct pre-token is segmented once.
2. Documents are read again. Frequencies of the most common pre-tokens (at most
   ``head`` of them, a fixed bound) are joined to their counts in a broadcast
   hash table, so hot words never move. All others are joined to the vocabulary
   table by a shuffle. Both sums meet per document.

The split into head and rest only decides how a pre-token is joined; all are
counted, whatever ``head`` is.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, scratch

#: Pre-tokens in the broadcast table. With at most 64 characters each, it stays under 64 MB.
HEAD = 300_000
HEAD_CHARS = 64
#: Distinct pre-tokens that a task holds before it passes their counts on.
FLUSH = 600_000
#: Chunks whose decomposition a Python worker remembers.
MEMO = 150_000

SPACE = "▁"
#: A run of spaces and the letters or the other characters behind it.
FINE = re.compile(r" *(?:[^\W\d_]+|(?:[^\w ]|[\d_])+)| +")
#: A run of spaces and what is behind it.
COARSE = re.compile(r" +[^ ]*|[^ ]+")


@functools.lru_cache(2)
def _model(path: str):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    spec.normalizer_spec.add_dummy_prefix = False  # pre-tokens bring their spaces
    own = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    pieces = [own.id_to_piece(i).replace(SPACE, " ") for i in range(own.vocab_size()) if not (own.is_control(i) or own.is_byte(i) or own.is_unknown(i))]
    split = next((p for p in (FINE, COARSE) if not any(_crosses(p, x) for x in pieces)), None)
    return own, split


def _crosses(pattern: re.Pattern, piece: str) -> bool:
    """Whether the piece would lie in two pre-tokens."""
    return len(pattern.findall(piece)) > 1


class PieceCounter:
    """Pre-tokens of texts and their piece counts, for one model."""

    def __init__(self, path: str) -> None:
        self.model, self.split = _model(path)
        self.memo: dict[str, list[str]] = {}

    def pretokens(self, text: str) -> Counter:
        """Pre-tokens, spaces kept, with how often each occurs."""
        if not text:
            return Counter()
        text = text.replace(SPACE, " ") if SPACE in text else text
        if self.split is None:
            return Counter({" " + text: 1})
        out: Counter = Counter()
        if "  " in text or text[0] == " " or text[-1] == " ":
            out.update(self.split.findall(" " + text))
            return out
        for chunk, n in Counter(text.split(" ")).items():
            for x in self.parts(chunk):
                out[x] += n
        return out

    def parts(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk that has no spaces and follows one."""
        found = self.memo.get(chunk)
        if found is None:
            found = self.split.findall(" " + chunk)
            if len(chunk) <= HEAD_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = found
        return found

    def counts(self, pretokens: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(pretokens, num_threads=1)]


def _vocabulary(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chunks, seen = PieceCounter(path), Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, n in chunks.items():
                for x in pieces.parts(chunk):
                    seen[x] += n
            chunks.clear()
            keys, ns = list(seen), list(seen.values())
            seen.clear()
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.string()), pa.array(ns[i : i + 50_000], pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                text = text.replace(SPACE, " ") if SPACE in text else text
                if pieces.split is None or "  " in text or text[0] == " " or text[-1] == " ":
                    seen.update(pieces.pretokens(text))
                else:
                    chunks.update(text.split(" "))
                if len(chunks) + len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _segmented(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces.counts(batch.column(0).to_pylist()), pa.int64())], ["pretoken", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token of the corpus: ``pretoken, n, pieces``."""
    counted = docs.select(F.col(text)).mapInArrow(_vocabulary(model_path), "pretoken string, n long")
    return counted.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(_segmented(model_path), "pretoken string, n long, pieces long")


def _head(words: DataFrame, most: int) -> dict[str, int]:
    """Piece counts of the most common pre-tokens, at most ``most``."""
    short = words.where(F.length("pretoken") <= HEAD_CHARS).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    left, level = most, None
    for row in short.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred levels at most
        left -= row["count"]
        if left < 0:
            break
        level = row["level"]
    if level is None:
        return {}
    got = short.where(F.col("level") >= level).select("pretoken", "pieces").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


#: A document's own row has no pre-token; its key only spreads it.
SCHEMA = "row long, id long, bytes long, head long, pretoken string, n long"


def _frequencies(path: str, head) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, numbers = PieceCounter(path), head.value, RowNumbers()
        sums: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], [], []]
            for row, i, text in zip(numbers.take(len(ids)), ids, texts, strict=True):
                total, rest = 0, Counter()
                text = text or ""
                plain = text.replace(SPACE, " ") if SPACE in text else text
                if not plain or pieces.split is None or "  " in plain or plain[0] == " " or plain[-1] == " ":
                    pairs = pieces.pretokens(plain).items()
                    for x, n in pairs:
                        c = known.get(x)
                        if c is None:
                            rest[x] += n
                        else:
                            total += n * c
                else:
                    for chunk, n in Counter(plain.split(" ")).items():
                        c = sums.get(chunk)
                        if c is not None:
                            total += n * c
                            continue
                        own = 0
                        missing = False
                        for x in pieces.parts(chunk):
                            c = known.get(x)
                            if c is None:
                                rest[x] += n
                                missing = True
                            else:
                                own += c
                        total += n * own
                        if not missing and len(chunk) <= HEAD_CHARS:
                            if len(sums) >= MEMO:
                                sums.clear()
                            sums[chunk] = own
                k = len(rest)
                rows[0] += [row] * (k + 1)
                rows[1] += [i] + [None] * k
                rows[2] += [len(text.encode())] + [None] * k
                rows[3] += [total] + [None] * k
                rows[4] += [f"\x00{row}", *rest]
                rows[5] += [None, *rest.values()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["row", "id", "bytes", "head", "pretoken", "n"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Tokens of every text: ``id, n_bytes, n_tokens``, one row for each input row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated
    or null ids each keep a row of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch(spark, "pretokens")
    vocabulary(docs, model_path, text).write.parquet(path)
    words = spark.read.schema("pretoken string, n long, pieces long").parquet(path)
    common = spark.sparkContext.broadcast(_head(words, head))
    parts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(_frequencies(model_path, common), SCHEMA)
    joined = parts.join(words.select("pretoken", "pieces"), "pretoken", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("id").alias("id"), F.max("bytes").alias("n_bytes"), (F.max("head") + F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
        .select("id", "n_bytes", "n_tokens")
    )
