"""Language identification by nearest centroids of TF-IDF character n-grams.

A text is read lower-cased, runs of characters other than letters as one blank; its vector counts hashed
n-grams of one to three characters, dampened by a square root, times the inverse document frequency, at unit
length. Document frequencies are counted over all training rows. For the centroids every language gives a
bounded sample (``SAMPLE_PER_LANGUAGE`` rows of smallest hash), clustered by spherical k-means into
``CENTROIDS``, so that a language's varieties keep centroids of their own. A text gets the language of the
most similar centroid, the cosine is its score; it is rejected where the cosine distance is above what the
``REJECT`` quantile of the language's own sample has.

Edge cases: a null text and one without any letter are ``und`` with score 0; training rows without language or
text teach nothing; with no training rows everything is ``und``; whole texts count however long, in pieces;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.llm.common import below_share, small_batches
from matchloom.llm.shingles import mix

DIMENSIONS = 1 << 13
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
REJECT = 0.999
_PIECE = 1 << 20
_NO_LETTER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None for a text without a letter."""
    if not text:
        return None
    out, any_letter = np.zeros(DIMENSIONS, np.int64), False
    for at in range(0, len(text), _PIECE):
        plain = " " + _NO_LETTER.sub(" ", text[at : at + _PIECE].lower()).strip(" ") + " "
        if len(plain) < 3:
            continue
        any_letter = any_letter or any(c.isalpha() for c in plain[1:4]) or any(map(str.isalpha, plain))
        letters = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        pairs = letters[:-1] * np.uint64(0x110000) + letters[1:]
        triples = pairs[:-1] * np.uint64(0x110000) + letters[2:]
        for n, grams in enumerate((letters, pairs, triples)):
            place = mix(grams + np.uint64(n << 62)) & np.uint64(DIMENSIONS - 1)
            out += np.bincount(place.astype(np.int64), minlength=DIMENSIONS)
    return out if any_letter else None


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, unit length
    owner: np.ndarray  # language number of each centroid
    limit: np.ndarray  # largest accepted distance of each language

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection for rows of counts."""
        cosine = np.clip(weighted(rows, self.idf) @ self.centroids.T, 0.0, 1.0)
        nearest = cosine.argmax(axis=1)
        score = cosine[np.arange(len(rows)), nearest]
        language = self.owner[nearest]
        return language, score, 1.0 - score > self.limit[language]


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(rows) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with the first row and then always the row farthest from those chosen."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        member = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[member == i].sum(axis=0) if (member == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _document_frequency(source):
    """One row per n-gram slot and task: how many of the task's texts hold it."""
    found, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in source:
        for text in batch.column("text").to_pylist():
            row = counts(text)
            if row is not None:
                found += row > 0
                texts += 1
    slots = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"slot": np.append(slots, -1), "n": np.append(found[slots], texts)})


def _sample_rows(source):
    for batch in source:
        out = {"lang": [], "slots": [], "n": []}
        for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            row = counts(text)
            if row is not None:
                slots = np.flatnonzero(row)
                out["lang"].append(language)
                out["slots"].append(slots)
                out["n"].append(row[slots])
        yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("slots", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))


def _sample(known: DataFrame, per_language: int) -> DataFrame:
    """Of every language the ``per_language`` distinct texts of smallest hash; copies count once."""
    # one number per language, as the model has: literals keep the texts out of a shuffle by language
    counts_ = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts_:
        return known
    shares = {language: min(1.0, (2.0 * per_language + 100) / n) for language, n in counts_.items()}
    keyed = known.withColumn("__key", F.xxhash64("text"))
    # what lies below the hash at which about enough rows are expected
    keyed = keyed.filter(below_share(F.col("__key"), _by_language(shares)))
    order = Window.partitionBy("lang").orderBy("__key")
    least = keyed.select("lang", "__key").distinct().withColumn("__rank", F.row_number().over(order))
    least = least.filter(F.col("__rank") <= per_language).groupBy("lang").agg(F.max("__key").alias("limit"))
    limits = {r.lang: r.limit for r in least.collect()}
    if not limits:
        return known.filter("false")
    sample = keyed.filter(F.col("__key") <= _by_language(limits))
    return sample.dropDuplicates(["lang", "__key"]).select("text", "lang")


def _by_language(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))


def fit(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, reject: float = REJECT
) -> LanguageModel | None:
    """Learn from the rows of ``docs(text, lang)``; None when none has a language and a letter."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    found = known.select("text").mapInArrow(_document_frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    by_slot = {r.slot: r.n for r in found.collect()}  # one row per slot
    total = by_slot.pop(-1, 0)
    if not total:
        return None
    frequency = np.zeros(DIMENSIONS)
    frequency[list(by_slot)] = list(by_slot.values())
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    rows: dict[str, list] = {}
    for r in _sample(known, per_language).mapInArrow(_sample_rows, "lang string, slots array<long>, n array<long>").collect():
        row = np.zeros(DIMENSIONS, np.float32)
        row[r.slots] = r.n
        rows.setdefault(r.lang, []).append(row)
    languages = sorted(rows)
    centres, owner, limit = [], [], []
    for number, language in enumerate(languages):
        vectors = weighted(np.array(rows[language]), idf)
        own = clustered(vectors, centroids)
        centres.append(own)
        owner += [number] * len(own)
        limit.append(float(np.quantile(1 - (vectors @ own.T).max(axis=1), reject)))
    return LanguageModel(languages, idf, np.concatenate(centres), np.array(owner), np.array(limit))


def _predictions(broadcast):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(source):
        model = broadcast.value
        for batch in small_batches(source, "text", 2 << 20):
            rows = [counts(t) for t in batch.column("text").to_pylist()]
            label, score, rejected = [UNKNOWN] * len(rows), [0.0] * len(rows), [True] * len(rows)
            kept = [i for i, r in enumerate(rows) if r is not None] if model else []
            for at in range(0, len(kept), 256):
                part = kept[at : at + 256]
                language, cosine, off = model.predict(np.array([rows[i] for i in part], np.float32))
                for i, number, c, o in zip(part, language, cosine, off):
                    label[i], score[i], rejected[i] = model.languages[number], float(c), bool(o)
            own = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(label), pa.array(score), pa.array(rejected)], [*names, *schema.names])

    return run


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred, score, rejected`` added (columns of these names are replaced)."""
    added = ("lang_pred", "score", "rejected")
    source = docs.select(*[c for c in docs.columns if c.lower() not in added])
    schema = source.drop("text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return source.mapInArrow(_predictions(docs.sparkSession.sparkContext.broadcast(model)), schema)
