"""Files into sources, by extension. Reading is Spark's, so any store it reaches will do."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .bundle import JSON, TABLE, TEXT, Source, SourceBundle
from .json_ranges import JsonFile
from .separated import Records

Loader = Callable[[SparkSession, str, str], Source]
_loaders: dict[str, Loader] = {}


def register_loader(*extensions: str) -> Callable[[Loader], Loader]:
    """Register a loader for file extensions; a later one replaces an earlier one."""

    def put(loader: Loader) -> Loader:
        for e in extensions:
            _loaders[e.lower()] = loader
        return loader

    return put


def supported_extensions() -> list[str]:
    return sorted(_loaders)


def loader_for(path: str) -> Loader:
    extension = PurePosixPath(path).suffix.lower()
    if extension not in _loaders:
        raise ValueError(f"no loader for {extension!r} files; known: {', '.join(supported_extensions())}")
    return _loaders[extension]


def ingest(spark: SparkSession, path: str, *, source_id: str | None = None, loader: Loader | None = None) -> Source:
    """Read one file; the id is the file's stem unless given."""
    path = str(path)
    return (loader or loader_for(path))(spark, path, source_id or PurePosixPath(path).stem)


def ingest_paths(spark: SparkSession, paths: Iterable[str]) -> SourceBundle:
    return SourceBundle(ingest(spark, p) for p in paths)


def ingest_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """Very many text files at once: ``source_id, text``, for one text source."""
    from pyspark.sql import functions as F

    read = spark.read.text(pattern, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))


def _whole(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row["value"] if row else ""


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _about(path: str) -> dict[str, str]:
    name = PurePosixPath(path)
    return {"filename": name.name, "format": name.suffix.lstrip(".").lower()}


@register_loader(".txt", ".text", ".md", ".markdown")
def load_text(spark: SparkSession, path: str, id: str) -> Source:
    return Source(id, _whole(spark, path), TEXT, metadata=_about(path))


def _separated(separator: str) -> Loader:
    def load(spark: SparkSession, path: str, id: str) -> Source:
        return Source(id, Records(spark, path, separator), TABLE, metadata=_about(path))

    return load


load_csv = register_loader(".csv")(_separated(","))
load_tsv = register_loader(".tsv")(_separated("\t"))


def table_files(spark: SparkSession, path: str, id: str, separator: str = ",") -> Source:
    """Very many separated files with one header as a table source, by Spark's own reader and rules."""
    return Source(id, spark.read.csv(path, sep=separator, header=True, inferSchema=False, multiLine=True, escape='"'), TABLE, metadata=_about(path))


@register_loader(".json")
def load_json(spark: SparkSession, path: str, id: str) -> Source:
    return Source(id, JsonFile(spark, path), JSON, metadata=_about(path))


@register_loader(".parquet", ".orc")
def load_columns(spark: SparkSession, path: str, id: str) -> Source:
    return Source(id, spark.read.format(PurePosixPath(path).suffix[1:].lower()).load(path), TABLE, metadata=_about(path))


@register_loader(".xlsx", ".xls")
def load_sheet(spark: SparkSession, path: str, id: str) -> Source:
    """The active sheet; a header cell without text is ``col`` and its number."""
    openpyxl = _needed("openpyxl", "spreadsheets")
    sheet = openpyxl.load_workbook(io.BytesIO(_bytes(spark, path)), read_only=True, data_only=True).active
    rows = sheet.iter_rows(values_only=True)
    header = [f"col{i}" if c is None else str(c) for i, c in enumerate(next(rows, ()))]
    return Source(id, [dict(zip(header, r, strict=False)) for r in rows], TABLE, metadata=_about(path))


class _Article(HTMLParser):
    """Headings, paragraphs and lists of a page as Markdown; scripts, styles, menus and the like are left out."""

    OUT = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "br", "tr", "table", "ul", "ol", "blockquote", "pre", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs: Any) -> None:
        if tag in self.OUT:
            self.out.append(tag)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.lines.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.lines.append("- ")
        elif tag in self.BLOCK:
            self.lines.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.OUT and tag in self.out:
            while self.out.pop() != tag:
                pass
        elif tag in self.BLOCK or tag == "li" or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if not self.out:
            text = " ".join(data.split())
            if text:
                glue = " " if self.lines[-1] and not self.lines[-1].endswith(" ") and data[:1].isspace() else ""
                self.lines[-1] += glue + text + (" " if data[-1:].isspace() else "")


def html_to_markdown(html: str | None) -> str:
    """The main content of a page as Markdown; empty where there is none."""
    parser = _Article()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        return ""
    return "\n\n".join(x for line in parser.lines if (x := line.strip()) and x not in ("-", "#"))


def html_texts(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Pages as ``source_id, text``, in Arrow batches."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        return column.map(html_to_markdown)

    return pages.select(F.col(id).cast("string").alias("source_id"), convert(F.col(html)).alias("text"))


@register_loader(".html", ".htm")
def load_html(spark: SparkSession, path: str, id: str) -> Source:
    return Source(id, html_to_markdown(_whole(spark, path)), TEXT, metadata=_about(path))


@register_loader(".pdf", ".docx", ".pptx")
def load_document(spark: SparkSession, path: str, id: str) -> Source:
    converter = _needed("docling.document_converter", "PDF and office documents")
    stream = importlib.import_module("docling.datamodel.base_models").DocumentStream(name=PurePosixPath(path).name, stream=io.BytesIO(_bytes(spark, path)))
    return Source(id, converter.DocumentConverter().convert(stream).document.export_to_markdown(), TEXT, metadata=_about(path))


def _needed(module: str, what: str):
    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise ImportError(f"reading {what} needs the library {module.split('.')[0]}, which is not installed") from missing
