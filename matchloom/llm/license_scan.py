"""License scans by conditional compression.

Every licence keyword gives a candidate block, the words within ``CONTEXT`` words of it, so blocks are small however
long the text. A block is compressed by zstandard once alone and once with each template as a raw dictionary;
templates are ranked by the bytes that saves. All that save any are then compared word by word with the text around
the keyword, as far as the template reaches: a template is confirmed when its words stand there in order, the
keyword among them, with at most ``TOLERANCE`` of them missing or added and none of its telling words (names and
numbers) missing. The confirmed template that covers most words wins; keywords inside it are done. So the work is in
proportion to the number of keywords.

One row per finding: ``doc_id, license, first_word, last_word, saved_bytes, missing, added``. A block in which
no template is confirmed gives one row with a null licence and the best template's saving, for review; such blocks
that touch are one.

Edge cases: null, empty and keyword-free texts give no rows; repeated rows give repeated findings; ties in
saving go to the earlier template; whole texts are read however long; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import small_batches
from matchloom.llm.license_texts import TEMPLATES

CONTEXT = 12
TOLERANCE = 0.1
LEVEL = 19  # blocks are short; lower levels miss matches with the shortest templates
KEYWORD = (
    r"licen[sc]e|copyright|creative\s+commons|rights\s+reserved|permission\s+(?:is\s+hereby|to\s+use)|redistribution"
    r"|public\s+(?:domain|license)|\bcc[ -](?:by|0)"
)
_KEYWORD = re.compile(KEYWORD, re.I)
_WORDS = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: words that tell one licence from another
TELLING = frozenset(
    "mit bsd isc apache gnu lesser affero mozilla mpl cc by by-sa by-nc by-nd cc0 2-clause 3-clause attribution "
    "attribution-sharealike attribution-noncommercial domain reserved".split()
)
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("license", pa.string()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("saved_bytes", pa.int64()),
        ("missing", pa.list_(pa.string())),
        ("added", pa.list_(pa.string())),
    ]
)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Template:
    def __init__(self, license_: str, wording: str):
        self.license = license_
        self.words = words_of(wording)
        self.telling = [w in TELLING or w[0].isdigit() for w in self.words]
        self.must = {w for w, telling in zip(self.words, self.telling) if telling}
        content = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False)
        self.size = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(" ".join(self.words).encode()))

    def differences(self, block: list[str], at: int) -> tuple[int, int, list[str], list[str]] | None:
        """``(first, last, missing, added)`` where the template stands in the block, around the word number ``at``; None
        when it doesn't."""
        size = len(self.words)
        matcher = SequenceMatcher(None, self.words, block, autojunk=False)
        # the longest common run; where a template stands several times in the block, that of the one around the word
        whole = max(matcher.get_matching_blocks(), key=lambda m: m.size)
        near = SequenceMatcher(None, self.words, block[max(0, at - size) : at + size], autojunk=False).find_longest_match()
        if near.size >= whole.size:
            whole = near._replace(b=near.b + max(0, at - size))
        if not whole.size:
            return None
        slack = int(size * TOLERANCE) + 1
        begin = max(0, whole.b - whole.a - slack)
        region = block[begin : whole.b - whole.a + size + slack]
        found = [m for m in SequenceMatcher(None, self.words, region, autojunk=False).get_matching_blocks() if m.size]
        first, last = found[0].b, found[-1].b + found[-1].size
        have = {i for m in found for i in range(m.a, m.a + m.size)}
        there = {i for m in found for i in range(m.b, m.b + m.size)}
        missing = [i for i in range(size) if i not in have]
        added = [region[i] for i in range(first, last) if i not in there]
        if len(missing) + len(added) > size * TOLERANCE or any(self.telling[i] for i in missing):
            return None
        return begin + first, begin + last, [self.words[i] for i in missing], added


@functools.lru_cache(maxsize=1)
def templates() -> tuple[list[Template], zstandard.ZstdCompressor]:
    return [Template(*t) for t in TEMPLATES], zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


def marked_words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text and the numbers of those that a keyword touches."""
    lowered = text.lower()
    hits = [(m.start(), m.end()) for m in _KEYWORD.finditer(lowered)]
    if not hits:
        return [], []
    words, marked, hit = [], [], 0
    for number, match in enumerate(_WORDS.finditer(lowered)):
        words.append(match.group())
        while hit < len(hits) and hits[hit][1] <= match.start():
            hit += 1
        if hit < len(hits) and hits[hit][0] < match.end():
            marked.append(number)
    return words, marked


def findings(text: str) -> list[tuple]:
    """``(license, first, last, saved_bytes, missing, added)`` in the order of the text; last is exclusive."""
    words, marked = marked_words(text)
    out, free = [], 0  # words before `free` belong to a finding
    for at, mark in enumerate(marked):
        if mark < free:
            continue
        begin, end = max(free, mark - CONTEXT), min(len(words), mark + CONTEXT + 1)
        found = _best(words, free, begin, mark, end)
        if found[0] is not None:
            # windows without a licence reach up to it, no further
            while out and out[-1][0] is None and out[-1][2] > found[1]:
                earlier = out.pop()
                if earlier[1] < found[1]:
                    out.append((*earlier[:2], found[1], *earlier[3:]))
                    break
            free = found[2]
            out.append(found)
        elif out and out[-1][0] is None and out[-1][2] >= begin:
            out[-1] = (None, out[-1][1], end, max(out[-1][3], found[3]), [], [])
        else:
            out.append(found)
    return out


def _best(words: list[str], low: int, begin: int, mark: int, end: int) -> tuple:
    """The winning template at the keyword ``words[mark]``, not reaching below ``low``.

    All templates that save bytes on the window ``words[begin:end]`` are compared, the largest saving first; one that
    could not cover more words than the best confirmed so far is passed over.
    """
    known, alone = templates()
    content = " ".join(words[begin:end]).encode()
    size = len(alone.compress(content))
    saved = [size - len(t.compressor.compress(content)) for t in known]
    best, won = 0, None
    for i in sorted(range(len(known)), key=lambda i: -saved[i]):
        template = known[i]
        if saved[i] <= 0:
            break
        if len(template.words) * (1 + TOLERANCE) <= best:
            continue
        reach = int(len(template.words) * (1 + TOLERANCE)) + 2
        start = max(low, mark - reach)
        region = words[start : mark + reach]
        if not template.must.issubset(region):
            continue
        if found := template.differences(region, mark - start):
            first, last, missing, added = found
            covered = last - first - 2 * (len(missing) + len(added))
            if start + first <= mark < start + last and covered > best:
                best, won = covered, (template.license, start + first, start + last, saved[i], missing, added)
    return won or (None, begin, end, max(0, *saved), [], [])


def _scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(source, "text"):
        out = {name: [] for name in _SCHEMA.names}
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            for license_, first, last, *rest in findings(text):
                for name, value in zip(_SCHEMA.names, (doc_id, license_, first, last - 1, *rest)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, _SCHEMA)


def license_scan(docs: DataFrame) -> DataFrame:
    """Findings in ``docs(doc_id, text)``; texts without a keyword never leave the JVM."""
    candidates = docs.select("doc_id", "text").filter(F.col("text").rlike(f"(?i){KEYWORD}"))
    return candidates.mapInArrow(
        _scan,
        "doc_id long, license string, first_word long, last_word long, saved_bytes long, missing array<string>, added array<string>",
    )
