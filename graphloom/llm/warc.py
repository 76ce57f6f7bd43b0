"""WARC archives in individually compressed Zstandard frames with an embedded dictionary.

An archive starts with a skippable frame that holds a dictionary, then has one
frame for each record, so a record can be read by its offset alone. The
dictionary is trained on records that a hash picks from all of the task's
records; they are sorted to the front, so training needs no second pass. Where
they are too few or too short to train on, their bytes themselves are the
dictionary. Payloads that are equal are stored once; the other records revisit
the one with the smallest id.

Every task writes its own files under names that no other attempt uses and
reports them; only reported files count, so a task that runs again leaves no
doubled records. Files are reached through the store that the folder's scheme
names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_join, kept, store, stored

SKIPPABLE = 0x184D2A5D
FRAME = struct.pack("<I", 0xFD2FB528)
#: Bytes of records from which a dictionary is trained, in expectation, and its size at most.
TRAIN_BYTES, DICTIONARY = 4 << 20, 64 << 10
LEVEL = 3
#: A file is closed, and another begun, beyond so many bytes.
ARCHIVE_BYTES = 512 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, row: int) -> str:
    """A version 8 UUID that carries the page id, whether there is one, and the row's number, which makes it unique."""
    value, row = (page or 0) % (1 << 64), (row << 1 | (page is None)) % (1 << 58)
    own = uuid.UUID(int=((row >> 10) << 80) | (8 << 76) | ((row & 1023) << 66) | ((value >> 62) << 64) | (2 << 62) | (value & ((1 << 62) - 1)))
    return f"<urn:uuid:{own}>"


def page_of(record: str) -> int | None:
    own = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    value = ((own >> 64) & 3) << 62 | own & ((1 << 62) - 1)
    return None if own >> 66 & 1 else value - (1 << 64) if value >> 63 else value


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value without white space or controls, which are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record(row: int, page: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: tuple[int, int | None] | None) -> bytes:
    """One WARC record; a revisit (``refers_to``: row and page of the response) keeps the HTTP headers and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", one_line(url)))
    if refers_to:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to[1], refers_to[0]))]
    else:
        block += payload
    return written([*headers, ("Content-Length", str(len(block)))], block)


def written(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]):
    """A dictionary of the records; their last bytes as they are where training has too little to go by."""
    import zstandard

    # short samples cut from long records: each begins where a match would help
    samples = [r[i : i + 16_384] for r in records for i in range(0, len(r), 16_384)]
    size = min(DICTIONARY, sum(map(len, samples)) // 10)
    if size >= 1024 and len(set(samples)) > 8:
        made = zstandard.train_dictionary(size, samples, k=256, d=8)
    else:
        made = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return made


class Archive:
    """A file that is being written, with a dictionary in front."""

    def __init__(self, filesystem, path: str, dictionary) -> None:
        import zstandard

        self.path, self.file = path, filesystem.open_output_stream(path, compression=None)
        self.size = self.records = 0
        body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        self._put(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]
        self.add(written(about, b""))

    def add(self, one: bytes) -> None:
        self.records += 1
        self._put(self.compressor.compress(one))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        return self.path, self.records - 1, self.size


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[bool, bytes]]:
    """Whether a record teaches, and the record."""
    html = batch.column("html").view(pa.binary()).to_pylist()
    names = ("row", "page", "url", "size", "sha", "low_row", "low_page", "teaches")
    for payload, row, page, url, size, sha, low_row, low_page, teaches in zip(html, *(batch.column(n).to_pylist() for n in names), strict=True):
        yield teaches, record(row, page, url, payload, size, sha, None if low_row is None else (low_row, low_page))


def _written(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = store(folder)
        filesystem.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "000000-0"
        done, archive, dictionary, first = [], None, None, []

        def put(one: bytes) -> None:
            nonlocal archive, dictionary
            if archive is None:
                if dictionary is None:
                    dictionary = trained(first or [one])
                archive = Archive(filesystem, f"{path}/pages-{name}-{len(done):04d}.warc.zst", dictionary)
            archive.add(one)
            if archive.size >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None

        def flush() -> None:
            held = first[:]
            for one in held:
                put(one)
            first.clear()

        for batch in batches:
            for teaches, one in _rows(batch):
                if teaches and dictionary is None:
                    first.append(one)
                    continue
                if first:
                    flush()
                put(one)
        flush()
        if archive:
            done.append(archive.close())
        for own, records, size in done:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages under ``folder``; returns the files: ``path, records, bytes``.

    Null html is an empty payload; a null URL gives a record without one. Of
    equal payloads, empty ones too, one is stored, with the smallest id; all
    others revisit it, repeated ids and repeated rows too. Null ids come after
    all others. Other columns are not read; an empty table gives no file.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    own = kept(numbered.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "xx": F.xxhash64("html"), "size": F.octet_length("html").cast("long")}), "pages", "zstd")[0]
    same = ["sha", "xx", "size"]
    keyed = own.select("row", "page", *same)
    low = F.min(F.struct(F.col("page").isNull().alias("null"), "page", "row"))
    lows, lows_path = kept(keyed.groupBy(*same).agg(low.alias("low"), F.count("*").alias("n")).where("n > 1"), "payloads")
    revisits, path = kept(hot_join(keyed, lows, same, "n").where("row <> low.row").select("row", F.col("low.row").alias("low_row"), F.col("low.page").alias("low_page")), "revisits")
    dropped(own.sparkSession, lows_path)
    total = own.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["size"] or 0) // ARCHIVE_BYTES)
    share = min(1.0, TRAIN_BYTES * parts / ((total["size"] or 0) + 500 * total["n"] + 1))
    marked = own.join(revisits, "row", "left").select(
        "row", "page", "url", F.when(F.col("low_row").isNull(), F.col("html")).alias("html"), "size", "sha", "low_row", "low_page", (F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).alias("teaches")
    )
    dealt = marked.repartition(parts, "row").sortWithinPartitions(F.desc("teaches"), "row")
    out = stored(dealt.mapInArrow(_written(folder), "path string, records long, bytes long"), "archives")
    dropped(own.sparkSession, path)
    return out


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    import zstandard

    known, head = None, file.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        body = file.read(struct.unpack("<I", head[4:])[0])
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body.startswith(FRAME) else body)  # trained or plain bytes, as it begins
        head = b""
    reader = zstandard.ZstdDecompressor(dict_data=known)
    left, data = head, b"\0"
    while data or left:
        one, out = reader.decompressobj(), []
        while not one.eof:
            data = left or file.read(1 << 20)
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(one.decompress(data))
            left = one.unused_data if one.eof else b""
        yield parsed(b"".join(out))


def parsed(one: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = one.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:n]


def described(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page, payload length, digest, type and page referred to; a stored payload is held against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload), digest(payload)) != (length, said):
        raise ValueError("a payload differs from its digest")
    return page_of(headers["WARC-Record-ID"]), length, said, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = store(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with filesystem.open_input_stream(path, compression=None) as file:
                    for headers, block in records(file):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(described(headers, block))
                        if len(rows) >= 20_000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return run


def read(archives: DataFrame, folder: str) -> DataFrame:
    """All page records of the archives in ``path``, as ``READ`` has them."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts).mapInArrow(_read(folder), READ)
