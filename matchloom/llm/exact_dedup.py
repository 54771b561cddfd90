"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after deleting every blank ``[\\x20\\x09-\\x0D]``. Records are
dealt out by a hash of what remains. A task that holds more content than its memory budget writes its
records to spill files by further bits of the hash and treats each file by itself, again if need be,
until the contents of one fit an open-addressing table, in which whole contents are compared.

The same step runs twice: over the rows of each input split, so that of a text which stands in a third
of all rows every split sends one record, and over the hash partitions after the shuffle.

Edge cases: a null text counts as empty, empty texts are one group; a null doc_id is the last choice
among ties; of rows that agree in text length and doc_id exactly one is kept; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import BLANKS, small_batches

FANOUT_BITS = 4
MEMORY_BYTES = 128 << 20
_NO_ID = (1 << 63) - 1
_HEAD = struct.Struct("<QqqqqqI")

PARTIAL = pa.schema(
    [
        ("hash", pa.int64()),
        ("content", pa.binary()),
        ("rows", pa.int64()),
        ("length", pa.int64()),
        ("keep_id", pa.int64()),
        ("keep_row", pa.int64()),
        ("ties", pa.int64()),
    ]
)
_DDL = "hash long, content binary, rows long, length long, keep_id long, keep_row long, ties long"


class ContentTable:
    """Open addressing with linear probing; entries are compared by their whole content.

    A record is ``(hash, content, rows, length, keep_id, keep_row, ties)``: how many rows it stands for,
    the best of them (most code points, smallest id, smallest row number), and how many rows agree with
    the best one in length and id.
    """

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []
        self.size = 0

    def add(self, record: tuple) -> None:
        mask = len(self.slots) - 1
        at = (record[0] >> 7) & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == record[0] and entry[1] == record[1]:
                self._merge(entry, record)
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append(list(record))
        self.size += len(record[1]) + 400
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    @staticmethod
    def _merge(entry: list, record: tuple) -> None:
        entry[2] += record[2]
        old, new = (-entry[3], entry[4]), (-record[3], record[4])
        if new < old:
            entry[3:] = record[3:]
        elif new == old:
            entry[5] = min(entry[5], record[5])
            entry[6] += record[6]

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for number, entry in enumerate(self.entries):
            at = (entry[0] >> 7) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def grouped(records: Iterator[tuple], memory: int = MEMORY_BYTES, depth: int = 0) -> Iterator[list]:
    """One record per distinct content, in bounded memory; spill files are gone when it ends."""
    table, files = ContentTable(), None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for record in records:
            if files is not None:
                _spill(files, record, depth)
                continue
            table.add(record)
            # when the hash has no further bits, only its collisions are left: they stay together
            if table.size > memory and len(table.entries) > 1 and (depth + 1) * FANOUT_BITS <= 64:
                files = [open(os.path.join(folder, str(i)), "wb") for i in range(1 << FANOUT_BITS)]
                for entry in table.entries:
                    _spill(files, entry, depth)
                table = None
        if files is None:
            yield from table.entries
            return
        for file in files:
            file.close()
        for file in files:
            yield from grouped(_unspill(file.name), memory, depth + 1)
            os.unlink(file.name)


def _spill(files: list, record, depth: int) -> None:
    hash_, content, *rest = record
    bucket = (hash_ >> (64 - FANOUT_BITS * (depth + 1))) & ((1 << FANOUT_BITS) - 1)
    files[bucket].write(_HEAD.pack(hash_, *rest, len(content)))
    files[bucket].write(content)


def _unspill(path: str) -> Iterator[tuple]:
    with open(path, "rb", buffering=1 << 20) as file:
        while head := file.read(_HEAD.size):
            hash_, *rest, size = _HEAD.unpack(head)
            yield (hash_, file.read(size), *rest)


def _emit(groups: Iterator[list]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for entry in groups:
        # to Spark's signed integers
        part.append([entry[0] - (1 << 64) if entry[0] >> 63 else entry[0], *entry[1:]])
        size += len(entry[1]) + 64
        if size > 8 << 20:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(part: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), PARTIAL)], schema=PARTIAL)


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    blanks = BLANKS.encode()
    for batch in small_batches(source, "text"):
        for doc_id, text, row in zip(*(c.to_pylist() for c in batch.columns)):
            content = text.encode("utf-8").translate(None, blanks)
            key = _NO_ID if doc_id is None else doc_id
            yield xxhash.xxh3_64_intdigest(content), content, 1, len(text), key, row, 1


def _local_groups(memory: int):
    return lambda source: _emit(grouped(_rows(source), memory))


def _merged_groups(memory: int):
    def records(source):
        for batch in small_batches(source, "content"):
            for hash_, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                yield (hash_ & 0xFFFFFFFFFFFFFFFF, *rest)

    return lambda source: _emit(grouped(records(source), memory))


def exact_groups(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct text of ``docs(doc_id, text, __row)``: content, rows, and which row stays."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__row")
    split = source.mapInArrow(_local_groups(memory), _DDL)
    return split.repartition("hash").mapInArrow(_merged_groups(memory), _DDL)


def _flagged(docs: DataFrame, memory: int) -> DataFrame:
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = exact_groups(numbered, memory).select(
        F.sha2("content", 256).alias("__sha256"),
        F.col("rows").alias("__size"),
        F.col("length").alias("__length"),
        F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("__keep_id"),
        F.col("keep_row").alias("__keep_row"),
        F.col("ties").alias("__ties"),
    )
    text = F.coalesce("text", F.lit(""))
    rows = numbered.withColumns({"__sha256": F.sha2(F.translate(text, BLANKS, ""), 256), "__chars": F.length(text)})
    best = (F.col("__chars") == F.col("__length")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    kept = best & ((F.col("__ties") == 1) | (F.col("__row") == F.col("__keep_row")))
    # the join shuffles the digests of all rows; a digest that a third of them share is split at run time
    return rows.join(groups, "__sha256").withColumn("__kept", kept)


def exact_dedup(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``keep_id, group_size, kept, text_sha256`` added, dropped rows too.

    Of equal texts the row with most code points stays, then the smallest doc_id. Columns of ``docs`` with
    one of the four names are replaced; names that begin with two underscores are reserved. ``docs``
    should be a stored table: it is read twice, and repeated rows with equal doc_id and length are told
    apart by their place in it.
    """
    added = {"keep_id": "__keep_id", "group_size": "__size", "kept": "__kept", "text_sha256": "__sha256"}
    own = [c for c in docs.columns if c.lower() not in added]
    return _flagged(docs, memory).select(*own, *[F.col(v).alias(k) for k, v in added.items()])


def drop_copies(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    return _flagged(docs, memory).filter("__kept").select(docs.columns)
