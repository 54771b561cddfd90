"""Token-id files with a shared zstandard dictionary and per-document access.

File format: a folder with two tables.

* ``dictionary``: one row ``(hash, dictionary, vocabulary)``. The dictionary is trained by zstandard on
  serialized id arrays of a bounded sample (``SAMPLE_DOCS`` documents, ``SAMPLE_IDS`` ids of each); the
  hash is the first 16 hexadecimal digits of its SHA-256.
* ``blocks``: rows ``(shard, block, dictionary_hash, first_id, last_id, doc_ids, starts, n_tokens, offsets,
  payload)``. A payload is a run of zstandard frames, one per document, each holding the document's ids as
  little-endian unsigned 32-bit integers; ``offsets`` are the frames' borders in the payload, ``starts``
  counts the ids before each document in its shard. Documents stand in ascending doc_id order within a
  block, blocks within a shard, shards by number. ``first_id`` and ``last_id`` let a reader skip blocks.

A document ends with the id ``END``. A block holds at most ``BLOCK_BYTES`` of frames or a single document.

Edge cases: a null or empty text is a document of one id; rows with a null doc_id come first and are read back with
the others, but can't be fetched; repeated rows are documents of their own, ``fetch`` gives all of an id, none of an
id that isn't there; a text longer than a block is a block of its own; an empty table gives a store without
documents; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import posixpath

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from matchloom.llm.common import batches, hash_sample, small_batches
from matchloom.llm.tokens import encoder

END = 1
BLOCK_BYTES = 4 << 20
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 64 << 10
_TAIL = np.array([END], "<u4").tobytes()

BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("dictionary_hash", pa.string()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
_BLOCKS_DDL = (
    "shard int, block int, dictionary_hash string, first_id long, last_id long, doc_ids array<long>, "
    "starts array<long>, n_tokens array<long>, offsets array<long>, payload binary"
)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary bytes; empty when the sample is too small to train one."""
    begins = docs.select("doc_id", F.substring("text", 1, 8 * SAMPLE_IDS).alias("text"))
    sample = hash_sample(begins, ["doc_id"], SAMPLE_DOCS, docs.count()).filter("text <> ''").select("text")

    def ids(source):
        encode = encoder(tokenizer).encode
        for batch in source:
            yield pa.RecordBatch.from_pydict({"ids": [encode(t)[: 4 * SAMPLE_IDS] for t in batch.column(0).to_pylist()]})

    serialized = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, serialized).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def _pack(tokenizer: str, dictionary: bytes, level: int):
    name = dictionary_hash(dictionary)

    def run(source):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False)
        block, before, ids, starts, counts, frames, size = 0, 0, [], [], [], [], 0

        def flush():
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard,
                "block": block,
                "dictionary_hash": name,
                "first_id": min(known, default=None),
                "last_id": max(known, default=None),
                "doc_ids": ids,
                "starts": starts,
                "n_tokens": counts,
                "offsets": [0, *np.cumsum([len(f) for f in frames]).tolist()],
                "payload": b"".join(frames),
            }
            return batches({k: [v] for k, v in row.items()}, BLOCKS)

        for batch in small_batches(source, "text"):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = encode(text) + _TAIL
                frame = compressor.compress(data)
                if frames and size + len(frame) > BLOCK_BYTES:
                    yield flush()
                    block, ids, starts, counts, frames, size = block + 1, [], [], [], [], 0
                ids.append(doc_id)
                starts.append(before)
                counts.append(len(data) // 4)
                frames.append(frame)
                size += len(frame)
                before += len(data) // 4
        if frames:
            yield flush()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer: str, level: int = 3) -> None:
    """Encode ``docs(doc_id, text)`` into the token files at ``path``; nulls come first, a null text is empty.

    Rows are dealt out by ranges of (doc_id, text hash, place), so a doc_id that many rows share is split
    over shards too. Texts are encoded once, after that one shuffle.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    row = spark.createDataFrame(
        [(dictionary_hash(dictionary), dictionary, posixpath.basename(tokenizer))], "hash string, dictionary binary, vocabulary string"
    )
    row.write.parquet(posixpath.join(path, "dictionary"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    dealt = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    dealt.select("doc_id", "text").mapInArrow(_pack(tokenizer, dictionary, level), _BLOCKS_DDL).write.parquet(
        posixpath.join(path, "blocks")
    )


def _decoded(dictionary: bytes, with_ids: bool):
    import zlib

    fields = [("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(source):
        name = dictionary_hash(dictionary)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in source:
            for block in batch.to_pylist():
                if block["dictionary_hash"] != name:
                    raise ValueError(f"block was written with dictionary {block['dictionary_hash']}, not {name}")
                payload, offsets = memoryview(block["payload"]), block["offsets"]
                out = {f.name: [] for f in schema}
                for i, (doc_id, start, count) in enumerate(zip(block["doc_ids"], block["starts"], block["n_tokens"])):
                    data = decompressor.decompress(payload[offsets[i] : offsets[i + 1]])
                    if len(data) != 4 * count:
                        raise ValueError(f"document {doc_id}: {len(data)} bytes for {count} ids")
                    out["shard"].append(block["shard"])
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["n_tokens"].append(count)
                    out["ids_crc32"].append(zlib.crc32(data))
                    if with_ids:
                        out["ids"].append(np.frombuffer(data, "<u4").astype(np.int64))
                yield batches(out, schema)

    return run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(posixpath.join(path, "dictionary")).first().dictionary)


def read_token_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``)."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(posixpath.join(path, "blocks"))
    run, ddl = _decoded(_dictionary(spark, path), with_ids)
    docs = blocks.mapInArrow(run, ddl)
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)).alias("total"))
    # one row per shard, and there are no more shards than shuffle partitions when the files were written
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    joined = docs.join(F.broadcast(before), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def fetch(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document, one row for each stored row of that id: only the blocks whose id range holds it are
    read, and only its own frames are decompressed."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(posixpath.join(path, "blocks"))
    blocks = blocks.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    places = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i).eqNullSafe(F.lit(doc_id)))
    at = blocks.withColumn("at", F.explode(places))
    begin, end = F.element_at("offsets", F.col("at")), F.element_at("offsets", F.col("at") + 1)
    one = at.select(
        "shard", "block", "dictionary_hash", "first_id", "last_id",
        *[F.slice(c, F.col("at"), 1).alias(c) for c in ("doc_ids", "starts", "n_tokens")],
        F.array(F.lit(0).cast("long"), end - begin).alias("offsets"),
        F.substring("payload", (begin + 1).cast("int"), (end - begin).cast("int")).alias("payload"),
    )
    run, ddl = _decoded(_dictionary(spark, path), True)
    return one.mapInArrow(run, ddl).select("doc_id", "n_tokens", "ids")
