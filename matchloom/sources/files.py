"""Resume files: type sniffing, text extraction, length guard."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.functions.text import squeeze

# Size and length limits, and the magic bytes of the two accepted kinds.
MAX_BYTES = 5_000_000
MIN_CHARS = 40
MAX_CHARS = 20_000
MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04"}

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Extractor = Callable[[bytes], str]


def with_kind(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``kind``: pdf or docx when both the extension and the magic bytes say so, else unsupported."""
    kind = F.lit("unsupported")
    for name, magic in MAGIC.items():
        hit = F.lower(path).endswith("." + name) & (
            F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))
        )
        kind = F.when(hit, name).otherwise(kind)
    return files.withColumn("kind", kind)


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, length, kind, content``. Files over ``max_bytes`` are listed but never opened: the
    length filter reaches the source, and ``content`` is not selected for them."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = with_kind(source.filter(F.col("length") <= max_bytes))
    large = source.filter(F.col("length") > max_bytes).select("path", "length")
    return small.select("path", "length", "kind", "content").unionByName(
        large.withColumn("kind", F.lit("too_large")), allowMissingColumns=True
    )


def _runs_text(paragraph: ElementTree.Element) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join(
        (node.text or "") if node.tag == _W + "t" else marks.get(node.tag, "") for node in paragraph.iter()
    )


def _table_cells(table: ElementTree.Element) -> Iterator[str]:
    """Cell texts row by row. A merged cell counts once for every grid column and row it covers."""
    above: dict[int, str] = {}
    for row in table.findall(_W + "tr"):
        column = 0
        for cell in row.findall(_W + "tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            continues = merge is not None and merge.get(_W + "val") != "restart"
            text = above.get(column, "") if continues else "\n".join(_runs_text(p) for p in cell.findall(_W + "p"))
            for _ in range(int(span.get(_W + "val")) if span is not None else 1):
                above[column] = text
                column += 1
                yield text


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then every non-empty table cell, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    lines = [_runs_text(p) for p in body.findall(_W + "p")]
    for table in body.findall(_W + "tbl"):
        lines.extend(text for text in _table_cells(table) if text)
    return "\n".join(lines)


def extract_text(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """``path, length, kind, status, raw_text``: run the extractor registered for each kind.

    ``extractors`` maps a kind to a callable from bytes to text; docx is built in. Status is ``ok``,
    ``unreadable``, ``no_extractor``, ``unsupported`` or ``too_large``.
    """
    registry: dict[str, Extractor] = {"docx": docx_text, **(extractors or {})}

    def one(kind: str, content: bytes | None) -> tuple[str, str | None]:
        if kind not in MAGIC:
            return kind, None
        if kind not in registry:
            return "no_extractor", None
        try:
            return "ok", registry[kind](bytes(content))
        except Exception:  # a broken upload is a row with a status, not a failed job
            return "unreadable", None

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outcome = [one(k, c) for k, c in zip(frame["kind"], frame["content"])]
            yield frame[["path", "length", "kind"]].assign(
                status=[s for s, _ in outcome], raw_text=[t for _, t in outcome]
            )

    return files.select("path", "length", "kind", "content").mapInPandas(
        batch, "path string, length long, kind string, status string, raw_text string"
    )


def extract_docx(files: DataFrame) -> DataFrame:
    return extract_text(files.filter(F.col("kind") == "docx")).select("path", "raw_text")


def guard_extracted(
    df: DataFrame,
    text: str = "raw_text",
    length: str | None = None,
    status: str | None = None,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``status, text, char_count, truncated`` from the extracted text.

    Too short a text is ``empty``; a long one is cut to ``max_chars``. ``length`` names a column of
    file sizes to check, ``status`` a column of earlier outcomes other than ``ok`` to keep.
    """
    flat = squeeze(text)
    outcome = F.when(F.length("_flat") < min_chars, F.lit("empty")).otherwise(F.lit("ok"))
    if length is not None:
        outcome = F.when(F.col(length) > max_bytes, F.lit("too_large")).otherwise(outcome)
    if status is not None:
        outcome = F.when(F.col(status) != "ok", F.col(status)).otherwise(outcome)
    ok = F.col("status") == "ok"
    return (
        df.withColumn("_flat", flat)
        .withColumn("status", outcome)
        .withColumn("text", F.when(ok, F.substring("_flat", 1, max_chars)))
        .withColumn("char_count", F.when(ok, F.least(F.length("_flat"), F.lit(max_chars))))
        .withColumn("truncated", F.when(ok, F.length("_flat") > max_chars))
        .drop("_flat")
    )
