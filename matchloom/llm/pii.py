"""Personal data by aggregation of weak labelers.

*Base spans* follow four fixed patterns (e-mail, IP address, payment card, phone number with a plus) and always
stay. Around them are *candidates*: the base spans themselves and looser forms of the same kinds, such as
``name [at] host [dot] org``, ``(988) 555-2485``, a card number that fails its check digit or an IPv6 address.

1. Labelers look at a candidate and vote for it, against it, or abstain: regular expressions (form, typical
   shape, odd digits, what it is glued to), gazetteers (top-level domains, issuers, country codes, reserved
   networks) and contexts (words before it that announce such data or something else, data close by).
2. The votes of all candidates are counted by kind and combination; the combinations are few whatever the size
   of the table. On these counts expectation-maximisation estimates, without any labelled row, how often
   data of a kind stands behind a candidate and how reliable each labeler is.
3. The resulting probabilities are the soft labels of a logistic span classifier, which sees hashed features of a
   span and its surroundings instead of the votes. It learns from a bounded sample (``SAMPLE_SPANS`` candidates
   of smallest hash).
4. A second pass over the texts writes each document's base spans and the candidates which the classifier gives
   ``THRESHOLD`` or more and which touch no base span.

Edge cases: a null text is empty and has no spans; texts are read whole, in time proportional to their length
(patterns are tried at their anchors, never from every character on); repeated rows give repeated results;
of overlapping added spans of one kind the first stays; without candidates nothing is added; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import bound_batches, hash_sample, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE_SPANS = 20_000
THRESHOLD = 0.9
SLOTS = 1 << 12
NEAR = 80  # characters within which other data count as close by
BEFORE = 48  # characters before a span that are searched for announcing words

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# looser forms
_AT = re.compile(r"(?i) ?[\[({<]at[\])}>] ?| at (?=[a-z0-9-]+ dot )|@")
_HOST = re.compile(r"(?i)[a-z0-9-]+(?: ?(?:\.|[\[({<]dot[\])}>]| dot ) ?[a-z0-9-]+)*+")
_RUN = re.compile(r"[(+]?[0-9][0-9 ().\-/]*+")
_V6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z:])")
_DEFANGED = re.compile(r"[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}+")

# Gazetteers.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz io dev app co eu de fr es it nl be at ch uk us ca au nz jp cn in br mx ru pl se no dk fi pt gr ie cz".split()
)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|6011|65|64[4-9]|62|35|50|5[6-9]|6[37]")
COUNTRY_CODES = re.compile(r"(?:00|\+)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
RESERVED = re.compile(r"0+\.|127\.|255\.|22[4-9]\.|2[34]\d\.")
# Words before a span that announce personal data, by kind, and words that announce something else.
ANNOUNCING = (
    re.compile(r"e-?mail|mailto|\bmail\b|contact|write to|reach|schreib|kontakt|contacte|correo|courriel|écri"),
    re.compile(r"\bip\b|address|adresse|dirección|server|serveur|servidor|host|login|client|connect"),
    re.compile(r"card|visa|master|amex|payment|credit|debit|karte|kredit|carte|tarjeta|paiement|pago"),
    re.compile(r"phone|\btel\b|tel[.:]|call|mobile|fax|whatsapp|sms|anruf|telefon|téléphone|appel|teléfono|llam|handy|portable|móvil"),
)
OTHERWISE = re.compile(
    r"version|release|\bv$|isbn|issn|doi|order|invoice|rechnung|facture|factura|serial|part no|page|seite|section|chapter|figure"
    r"|\bno\.?\s*$|\$|€|£|usd|eur|year|date|datum|fecha|total|count|sha|hash|token|password|key"
)
LABELERS = ("form", "shape", "odd digits", "glued", "gazetteer", "announced", "other matter", "close by")


class Candidate(NamedTuple):
    start: int
    end: int
    kind: int
    base: bool


def passes_check_digit(digits: str) -> bool:
    """The Luhn test."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _local_start(text: str, at: int, lowest: int) -> int:
    while at > lowest and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` is looked at once, so a long run of letters costs nothing."""
    past, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = _local_start(text, at, past)
            if start < at:
                past = domain.end()
                yield start, past
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers of a dotted run at a time, and whether they may be an address."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def base_spans(text: str) -> list[Candidate]:
    """The spans of the four fixed patterns, by start, then kind; those of one kind don't overlap."""
    found = [Candidate(s, e, EMAIL, True) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [Candidate(s, e, IP, True) for s, e, valid in _addresses(text) if valid]
        for m in _CHAIN.finditer(text):
            digits = _NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and passes_check_digit(digits):
                found.append(Candidate(m.start(), m.end(), CARD, True))
        for m in _PLUS.finditer(text) if "+" in text else ():
            if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                found.append(Candidate(m.start(), m.end(), PHONE, True))
    return sorted(found, key=lambda c: (c.start, c.kind))


def _loose(text: str) -> Iterator[Candidate]:
    past = 0
    for m in _AT.finditer(text) if "@" in text or "at" in text else ():
        host = _HOST.match(text, m.end())
        start = _local_start(text, m.start(), past)
        if host and start < m.start():
            past = host.end()
            yield Candidate(start, past, EMAIL, False)
    if not _DIGIT.search(text):
        return
    for start, end, _ in _addresses(text):
        yield Candidate(start, end, IP, False)
    for m in _V6.finditer(text) if text.count(":") > 2 else ():
        yield Candidate(m.start(), m.end(), IP, False)
    for m in _DEFANGED.finditer(text) if "[.]" in text or "(.)" in text else ():
        yield Candidate(m.start(), m.end(), IP, False)
    for m in _RUN.finditer(text):
        span = m.group().rstrip(" ().-/")
        digits = _NOT_DIGITS.sub("", span)
        end = m.start() + len(span)
        if 12 <= len(digits) <= 19:
            yield Candidate(m.start(), end, CARD, False)
        if 7 <= len(digits) <= 15 and len(span) > len(digits):
            yield Candidate(m.start(), end, PHONE, False)


def candidates(text: str) -> tuple[list[Candidate], list[Candidate]]:
    """``(base spans, loose candidates)``; a loose one touches no base span and none of its kind before it."""
    base = base_spans(text)
    # base spans in order of start; the furthest end so far tells whether a span is touched
    starts, reach = [c.start for c in base], []
    for c in base:
        reach.append(max(c.end, reach[-1] if reach else 0))
    loose, past = [], [0] * len(KINDS)
    for c in sorted(_loose(text), key=lambda c: (c.start, c.kind)):
        before = bisect_left(starts, c.end)
        if (not before or reach[before - 1] <= c.start) and c.start >= past[c.kind]:
            loose.append(c)
            past[c.kind] = c.end
    return base, loose


def _shape(c: Candidate, span: str, digits: str) -> int:
    if c.kind == EMAIL:
        return 1 if re.fullmatch(r"[\w.%+-]{2,64}@[\w.-]+\.[A-Za-z]{2,8}", span) else 0
    if c.kind == IP:
        return 1 if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", span) or span.count(":") == 7 else 0
    if c.kind == CARD:
        return 1 if len(digits) in (15, 16) and re.fullmatch(r"\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{3,4}", span) else 0
    dated = re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?: \d+)?|\d{4} ?- ?\d{4}", span)
    if dated or len(digits) < 9 and not span.startswith(("+", "(")):
        return -1
    return 1 if re.search(r"^\+|^00|\(\d{2,4}\)|^\d{3}[ .-]\d{3}[ .-]\d{4}$", span) else 0


def _gazetteer(c: Candidate, span: str, digits: str) -> int:
    if c.kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP_LEVEL else -1
    if c.kind == IP:
        return -1 if RESERVED.match(span) else 0
    if c.kind == CARD:
        return 1 if ISSUERS.match(digits) else -1
    return 1 if span.startswith(("+", "00")) and COUNTRY_CODES.match(span) else 0


def _valid(c: Candidate, span: str, digits: str) -> int:
    if c.base:
        return 1
    if c.kind == CARD:
        return 1 if passes_check_digit(digits) else -1
    if c.kind == IP:
        return -1 if span.count(".") == 3 and "[" not in span and "(" not in span else 0
    return 0


def votes(text: str, c: Candidate, ends: list[int]) -> list[int]:
    """One vote per labeler: 1, -1, or 0 for abstaining. ``ends`` are the ends of all candidates in order."""
    span = text[c.start : c.end]
    digits = _NOT_DIGITS.sub("", span)
    before, after = text[max(0, c.start - BEFORE) : c.start].lower(), text[c.end : c.end + 1]
    glued = before[-1:].isalnum() or before[-1:] in tuple("_=/#\"") or after.isalnum() or after in tuple("_=/\"")
    odd = c.kind != EMAIL and len(digits) > 6 and (len(set(digits)) < 3 or digits in "01234567890123456789")
    at = bisect_left(ends, c.start - NEAR)
    # its own end is among them
    close = at < len(ends) and (ends[at] < c.end or (at + 1 < len(ends) and ends[at + 1] <= c.end + NEAR))
    return [
        _valid(c, span, digits),
        _shape(c, span, digits),
        -1 if odd else 0,
        -1 if glued else 0,
        _gazetteer(c, span, digits),
        1 if ANNOUNCING[c.kind].search(before) else 0,
        -1 if OTHERWISE.search(before[-24:]) else 0,
        1 if close else 0,
    ]


def features(text: str, c: Candidate) -> list[int]:
    """Slots of the span's shape, its characters' classes at the borders, and the words around it."""
    span = text[c.start : c.end]
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", span[:64]))
    short = re.sub(r"9+", "9", form)
    left = text[max(0, c.start - BEFORE) : c.start].lower()
    right = text[c.end : c.end + 24].lower()
    near = lambda x: "9" if x.isdigit() else "a" if x.isalpha() else x
    names = [f"short={short}", f"digits={form.count('9')}", f"left={near(left[-1:])}", f"right={near(right[:1])}", f"long={len(span) // 4}"]
    names += [f"form={form[i : i + 3]}" for i in range(max(1, len(form) - 2))]
    names += [f"before={w}" for w in re.findall(r"[^\W\d_]+", left)[-2:]] + [f"after={w}" for w in re.findall(r"[^\W\d_]+", right)[:1]]
    slots = {len(KINDS) + zlib.crc32(f"{c.kind}{n}".encode("utf-8", "surrogatepass")) % (SLOTS - len(KINDS)) for n in names}
    return [c.kind, *sorted(slots)]


def code_of(cast: list[int]) -> int:
    """Votes as one number, three values a place."""
    return sum((v + 1) * 3**i for i, v in enumerate(cast))


@dataclass
class LabelModel:
    """What expectation-maximisation found out about one kind: the share of candidates that are data, and
    ``likelihood[labeler, vote + 1, class]``."""

    prior: float
    likelihood: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of being data for rows of votes."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            np.log(self.likelihood[i][cast[:, i] + 1]) for i in range(cast.shape[1])
        )
        return 1.0 / (1.0 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))

    def reliability(self) -> dict[str, float]:
        """By labeler, the probability that a vote it casts is right."""
        share = np.array([1 - self.prior, self.prior])
        out = {}
        for name, table in zip(LABELERS, self.likelihood):
            right, wrong = table[0, 0] * share[0] + table[2, 1] * share[1], table[2, 0] * share[0] + table[0, 1] * share[1]
            out[name] = float(right / (right + wrong))
        return out


def estimate(cast: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over combinations of votes and how often they were seen.

    It begins with the share of votes in favour; pseudo-counts that expect a labeler to be right more often than
    wrong keep the two classes from changing places.
    """
    model = None
    in_favour = 1.0 / (1.0 + np.exp(-1.5 * cast.sum(axis=1)))
    expected = np.array([[3.0, 1.0], [4.0, 4.0], [1.0, 3.0]])  # votes -1, 0, 1 by class
    for _ in range(rounds):
        weight = np.stack([counts * (1 - in_favour), counts * in_favour], axis=1)
        tables = []
        for i in range(cast.shape[1]):
            table = expected + np.stack([weight[cast[:, i] == v].sum(axis=0) for v in (-1, 0, 1)])
            tables.append(table / table.sum(axis=0))
        prior = float((weight[:, 1].sum() + 1) / (counts.sum() + 2))
        model, last = LabelModel(prior, np.array(tables)), in_favour
        in_favour = model.posterior(cast)
        if np.abs(in_favour - last).max() < 1e-9:
            break
    return model


def train(rows: list[list[int]], soft: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by AdaGrad over all rows; each row's slots are distinct."""
    weights, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-8)
    if not rows:
        return weights
    sizes = np.array([len(r) for r in rows])
    slots, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for _ in range(epochs):
        z = np.add.reduceat(weights[slots], starts)
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - soft) / len(rows)
        step = np.bincount(slots, np.repeat(error, sizes), minlength=SLOTS) + decay * weights / len(rows)
        seen += step**2
        weights -= rate * step / np.sqrt(seen)
    return weights


@dataclass
class SpanModel:
    labelers: dict[int, LabelModel]  # by kind
    weights: np.ndarray

    def probability(self, text: str, c: Candidate) -> float:
        z = float(self.weights[features(text, c)].sum())
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


_VOTED = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("votes", pa.int32()), ("slots", pa.list_(pa.int32()))])


def _voted(source):
    for batch in small_batches(source, "text"):
        out = {name: [] for name in _VOTED.names}
        for text in batch.column("text").to_pylist():
            base, loose = candidates(text)
            every = sorted(base + loose)
            ends = sorted(c.end for c in every)
            own = zlib.crc32(text.encode("utf-8", "surrogatepass")) if every else 0
            for c in every:
                out["key"].append((own << 24) ^ (c.start * 8 + c.kind))
                out["kind"].append(c.kind)
                out["votes"].append(code_of(votes(text, c, ends)))
                out["slots"].append(features(text, c))
        yield pa.RecordBatch.from_pydict(out, _VOTED)


def fit(docs: DataFrame, sample: int = SAMPLE_SPANS) -> SpanModel | None:
    """Learn from all candidates in ``docs(text)``; None when there are none."""
    texts = bound_batches(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    voted = stored(texts.mapInArrow(_voted, "key long, kind int, votes int, slots array<int>"), "voted")
    labelers, total = {}, 0
    # at most 4 x 3^8 combinations
    seen = voted.groupBy("kind", "votes").count().orderBy("kind", "votes").toArrow().to_pylist()
    for kind in sorted({r["kind"] for r in seen}):
        mine = [r for r in seen if r["kind"] == kind]
        cast = np.array([[r["votes"] // 3**i % 3 - 1 for i in range(len(LABELERS))] for r in mine])
        counts = np.array([float(r["count"]) for r in mine])
        labelers[kind] = estimate(cast, counts)
        total += int(counts.sum())
    if not total:
        return None
    chosen = hash_sample(voted, ["key", "kind", "votes"], sample, total).collect()
    cast = np.array([[r.votes // 3**i % 3 - 1 for i in range(len(LABELERS))] for r in chosen])
    kinds = np.array([r.kind for r in chosen])
    soft = np.zeros(len(chosen))
    for kind, model in labelers.items():
        if (kinds == kind).any():
            soft[kinds == kind] = model.posterior(cast[kinds == kind])
    return SpanModel(labelers, train([r.slots for r in chosen], soft))


def spans(text: str | None, model: SpanModel | None, threshold: float = THRESHOLD) -> tuple[list[Candidate], list[Candidate]]:
    """``(base spans, added spans)`` of a text."""
    base, loose = candidates(text or "")
    return base, [c for c in loose if model is not None and model.probability(text, c) >= threshold]


def written(found: list[Candidate]) -> str:
    return ",".join(f"{KINDS[c.kind]}:{c.start}:{c.end}" for c in sorted(found, key=lambda c: (c.start, c.kind, c.end)))


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame, model: SpanModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, the numbers of base spans by kind, the digest of the base
    spans as text, and all spans as text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(source):
        for batch in small_batches(source, "text"):
            out = {name: [] for name in _FOUND.names}
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                base, added = spans(text, broadcast.value, threshold)
                out["doc_id"].append(doc_id)
                for number, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(c.kind == number for c in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(base + added))
            yield pa.RecordBatch.from_pydict(out, _FOUND)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def redacted(docs: DataFrame, model: SpanModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as in ``<email>``; overlapping spans become one."""

    @F.arrow_udf("string")
    def replace(values: pa.Array) -> pa.Array:
        return pa.array([_replaced(v, model, threshold) for v in values.to_pylist()], pa.string())

    return docs.withColumn("text", replace("text"))


def _replaced(text: str | None, model: SpanModel | None, threshold: float) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for c in sorted(sum(spans(text, model, threshold), [])):
        if c.start >= at:
            out += [text[at : c.start], f"<{KINDS[c.kind]}>"]
        at = max(at, c.end)
    return "".join([*out, text[at:]])
