"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is ``sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, so a text costs time in proportion to its features.

Features: hashed words with dampened counts at unit length; statistics of the characters, words and lines,
each as a number in [0, 1] and as the bin it falls into; metadata columns (by default none), numbers binned by
their logarithm, other values hashed as they are. Training takes a bounded sample of labelled rows
(``SAMPLE_ROWS``, smallest hashes of the id) to the driver as feature rows, not texts, and learns by AdaGrad;
scoring is one pass over whole texts.

Edge cases: null and empty texts have the statistics of an empty text and are scored like any other; null
metadata adds no feature; without labelled rows every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import bound_batches, hash_sample, small_batches
from matchloom.llm.shingles import word_hashes

WORD_SLOTS = 1 << 14
META_SLOTS = 1 << 8
BINS = 12
FACTORS = 8
SAMPLE_ROWS = 6000
EPOCHS = 8
LEAST_STEPS = 400
STATISTICS = (
    "upper", "digit", "symbol", "mark", "blank", "line_ends", "words", "word_length",
    "distinct", "top_word", "repeated_next", "repeated_at_2", "symbol_kinds",
)
_STAT_AT = WORD_SLOTS
_BIN_AT = _STAT_AT + len(STATISTICS)
_META_AT = _BIN_AT + len(STATISTICS) * BINS
SLOTS = _META_AT + META_SLOTS
_PIECE = 1 << 20

_OTHER, _UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, _BLANK, _LINE = range(8)


def _kind(code: int) -> int:
    if code == 10:
        return _LINE
    if code in (9, 11, 12, 13, 32):
        return _BLANK
    if chr(code) in ".,;:!?'\"()-":
        return _MARK
    category = unicodedata.category(chr(code))
    if category == "Lu":
        return _UPPER
    return {"L": _LETTER, "N": _DIGIT, "P": _SYMBOL, "S": _SYMBOL, "Z": _BLANK}.get(category[0], _OTHER)


_KINDS = np.array([_kind(c) for c in range(1 << 16)], np.uint8)


def statistics(text: str, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values in [0, 1] in the order of ``STATISTICS``; ``hashes`` are those of the words in order."""
    kinds, symbols = np.zeros(8, np.int64), set()
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        of = _KINDS[np.minimum(codes, 0xFFFF)]
        kinds += np.bincount(of, minlength=8)
        symbols.update(np.unique(codes[(of == _SYMBOL) | (of == _MARK)]).tolist())
    chars, n = max(1, int(kinds.sum())), len(hashes)
    some = max(1, n)
    return np.minimum(
        1.0,
        [
            kinds[_UPPER] / chars,
            kinds[_DIGIT] / chars,
            4 * kinds[_SYMBOL] / chars,
            4 * kinds[_MARK] / chars,
            kinds[_BLANK] / chars,
            10 * kinds[_LINE] / chars,
            np.log1p(n) / 12,
            (chars - kinds[_BLANK] - kinds[_LINE]) / some / 20,
            len(counts) / some,
            counts.max(initial=0) / some,
            np.count_nonzero(hashes[1:] == hashes[:-1]) / some,
            np.count_nonzero(hashes[2:] == hashes[:-2]) / some,
            len(symbols) / 24,
        ],
    )


def features(text: str | None, metadata: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features."""
    text = text or ""
    hashes = word_hashes(text)
    distinct, counts = np.unique(hashes, return_counts=True)
    slots, at = np.unique((distinct & np.uint64(WORD_SLOTS - 1)).astype(np.int64), return_inverse=True)
    weight = np.sqrt(np.bincount(at, counts)) if len(slots) else np.zeros(0)
    weight /= max(1e-12, np.linalg.norm(weight))
    stats = statistics(text, hashes, counts)
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1) + np.arange(len(stats)) * BINS
    meta = [_META_AT + _meta_slot(k, v) for k, v in (metadata or {}).items() if v is not None]
    return (
        np.concatenate([slots, _STAT_AT + np.arange(len(stats)), _BIN_AT + bins, np.array(meta, np.int64)]).astype(np.int64),
        np.concatenate([weight, stats, np.ones(len(bins)), np.ones(len(meta))]).astype(np.float32),
    )


def _meta_slot(name: str, value) -> int:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = int(np.sign(value) * np.log2(1 + abs(value)) * 2) if np.isfinite(value) else "not finite"
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_SLOTS


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of rows laid end to end; every row has features."""
        z = self._raw(slots, values, starts)[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def _raw(self, slots, values, starts):
        part = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part**2, starts, axis=0)
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, part


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
          rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine | None:
    """Logistic loss by AdaGrad in batches of 128, at least ``LEAST_STEPS`` of them; None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean(), 0.01, 0.99))
    model = FactorisationMachine(float(np.log(mean / (1 - mean))), np.zeros(SLOTS), rng.normal(0, 0.02, (SLOTS, factors)))
    seen_w, seen_v, seen_b = np.full(SLOTS, 1e-3), np.full((SLOTS, factors), 1e-3), 1e-3
    for _ in range(max(epochs, -(-LEAST_STEPS * 128 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            sizes = np.array([len(rows[i][0]) for i in batch])
            slots = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch]).astype(float)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, sums, part = model._raw(slots, values, starts)
            error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(error, sizes) * values
            used, inverse = np.unique(slots, return_inverse=True)
            step_w = np.bincount(inverse, each) + decay * model.weights[used]
            pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - part)
            step_v = np.stack([np.bincount(inverse, pull[:, f]) for f in range(factors)], axis=1) + decay * model.factors[used]
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            seen_b += error.sum() ** 2
            model.weights[used] -= rate * step_w / np.sqrt(seen_w[used])
            model.factors[used] -= 0.3 * rate * step_v / np.sqrt(seen_v[used])
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


def _records(batch: pa.RecordBatch, metadata: tuple) -> list:
    columns = [batch.column(m).to_pylist() for m in metadata]
    for i, text in enumerate(batch.column("text").to_pylist()):
        yield features(text, {m: c[i] for m, c in zip(metadata, columns)})


def fit(labelled: DataFrame, label: str, metadata: tuple = (), sample: int = SAMPLE_ROWS) -> FactorisationMachine | None:
    """Learn from at most ``sample`` rows of ``labelled(doc_id, text, <label>, *metadata)``."""
    schema = pa.schema([("label", pa.float64()), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    def run(source):
        for batch in small_batches(source, "text"):
            found = list(_records(batch, metadata))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.float64()), pa.array([s for s, _ in found], schema.field(1).type),
                 pa.array([v for _, v in found], schema.field(2).type)], schema=schema)

    rows = labelled.select("text", F.col(label).alias("label"), *metadata).limit(sample)
    found = rows.mapInArrow(run, "label double, slots array<int>, values array<float>").toArrow()
    rows = [(s.values.to_numpy(), v.values.to_numpy()) for s, v in zip(found.column("slots"), found.column("values"))]
    model = train(rows, found.column("label").to_numpy())
    del rows, found
    pa.default_memory_pool().release_unused()  # the driver goes on, the sample should not
    return model


def sample_of(labels: DataFrame, label: str, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, <label>)`` of the ``sample`` rows with a label whose ids have the smallest hashes."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    return hash_sample(known, ["doc_id", label], sample)


def score(docs: DataFrame, model: FactorisationMachine | None, metadata: tuple = ()) -> DataFrame:
    """``docs`` with ``score`` added (a column of that name is replaced). Only text and metadata go to Python, only
    the score comes back."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    names = ["text", *metadata]

    @F.arrow_udf("double")
    def scored(*columns: pa.Array) -> pa.Array:
        machine, batch = broadcast.value, pa.RecordBatch.from_arrays(list(columns), names)
        out = [np.zeros(0)]
        for part in small_batches([batch], "text", 4 << 20):
            rows = list(_records(part, metadata))
            result = np.full(len(rows), 0.5)
            if machine is not None and rows:
                starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])[:-1]]).astype(int)
                result = machine.score(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]).astype(float), starts)
            out.append(result)
        return pa.array(np.concatenate(out), pa.float64())

    source = bound_batches(docs.select(*[c for c in docs.columns if c.lower() != "score"]))
    return source.withColumn("score", scored(*names))
