"""Packing by shortest-pack-first over the histogram of lengths.

Documents are encoded once and cut at every ``capacity`` ids; a cut-off rest is a piece of its own. Only
the histogram of piece lengths (at most ``capacity`` numbers) comes to the driver. There lengths are
placed longest first, all pieces of one length at a time: each goes to the packing pattern with the most
room left (the shortest pack) that still takes it, splitting the pattern's count where not all of its
packs get one, and opens new packs when none fits. The patterns go back to the pieces by rank: piece
number r of its length belongs to a known sequence and place.

Ranks are counted in hash buckets of the pieces, so a length that a third of all pieces share is ranked
in as many tasks as there are buckets, and no piece or text is gathered anywhere.

Edge cases: a null or empty text is one piece holding the end id; a null doc_id is kept as null; equal
rows make equal pieces, each with its own place; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm.common import batches, bound_batches, small_batches, stored
from matchloom.llm.tokens import encoder

END = 1
CAPACITY = 2048
BUCKETS = 256
_TAIL = np.array([END], "<u4").tobytes()
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs(doc_id, text)``: ``doc_id, start, length, ids_crc32, doc_tokens``
    (and ``ids``)."""
    schema = pa.schema(_FIELDS + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(source):
        encode = encoder(tokenizer).encode
        for batch in small_batches(source, "text"):
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = encode(text) + _TAIL
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(len(data) // 4)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64))
            yield batches(out, schema)

    return bound_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, _DDL + (", ids array<long>" if with_ids else "")
    )


def packing_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """``(count, ((length, pieces per pack), ...))``: packs by pattern, over all pieces of the histogram."""
    open_: dict[int, dict[tuple, int]] = {}  # room left -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=-1)
            if room < length:
                fits = capacity // length
                for copies, packs in ((fits, left // fits), (left % fits, 1)):
                    if copies and packs:
                        _add(open_, capacity - copies * length, ((length, copies),), packs)
                left = 0
                continue
            pattern, count = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            used = min(count, left)
            if used < count:
                _add(open_, room, pattern, count - used)
            _add(open_, room - length, _with(pattern, length), used)
            left -= used
    return sorted((count, pattern) for patterns in open_.values() for pattern, count in patterns.items())


def _add(open_: dict, room: int, pattern: tuple, count: int) -> None:
    patterns = open_.setdefault(room, {})
    patterns[pattern] = patterns.get(pattern, 0) + count


def _with(pattern: tuple, length: int) -> tuple:
    if pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + 1))
    return (*pattern, (length, 1))


def _places(patterns: list) -> dict[int, np.ndarray]:
    """By length, rows ``(first rank, first sequence, pieces per pack, offset in the pack)`` by rank."""
    rank: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            at = rank.get(length, 0)
            out.setdefault(length, []).append((at, sequence, copies, offset))
            rank[length] = at + count * copies
            offset += length * copies
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added. ``pieces`` is a stored table with ``doc_id,
    start, length, ids_crc32, doc_tokens``, no length above ``capacity``."""
    counted = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = counted.groupBy("length", "__bucket").count()
    # at most capacity x buckets rows
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(packing_patterns(histogram, capacity))

    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = counted.withColumn("__rank", F.row_number().over(order) - 1).join(base, ["length", "__bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__base") + F.col("__rank")).alias("__rank"))
    schema = ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(source):
        for batch in source:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                table = places[int(length)]
                row = table[np.searchsorted(table[:, 0], ranks[mine], "right") - 1]
                place = ranks[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + place // row[:, 2]
                offset[mine] = row[:, 3] + place % row[:, 2] * length
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "__rank"]
            names = [name for name in batch.schema.names if name != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs(doc_id, text)``; one row per piece."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence, ``sequence_id, ids, doc_ids``, of pieces that carry their ids."""
    one = F.struct("offset", "doc_id", "start", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("parts"))  # at most `capacity` ids
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
