"""Token ids of texts by the ``tokenizers`` library, fast on text of mostly plain words.

``TextEncoder.encode`` returns exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``,
as the bytes of little-endian unsigned 32-bit integers. As there, the string of an added token of the
vocabulary, such as ``<|endoftext|>``, is that token wherever it stands in a text.

Running the library's normaliser and pattern matcher over every text takes most of its time, although
most words have been seen before. So a text in plain Latin letters is cut at the pattern's own borders,
each new piece is encoded once by the library's model, and a table of at most ``_REMEMBER`` bytes remembers it.
Any other text, also one that holds the string of an added token, goes through the library as a whole; so does
every text when the vocabulary's file asks for steps this module doesn't know.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: characters whose class, case and normal form Python and the library agree on, without blanks but space and newline
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ňŊ-ž]*")
_SLICE = 1 << 18
#: bytes a table of remembered ids may take, with what Python needs for an entry
_REMEMBER, _ENTRY = 128 << 20, 190

#: pieces of the two known patterns, over plain characters: (pattern of pieces, lower-case first)
_BYTE_LEVEL = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered:
    """A table that is emptied when it has taken ``most`` bytes."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.ids: dict[str, bytes] = {}  # a plain one: sets are compared with it fast

    def make_room(self) -> dict[str, bytes]:
        if self.size > self.most:
            self.ids.clear()
            self.size = 0
        return self.ids

    def add(self, key: str, ids: bytes) -> bytes:
        self.ids[key] = ids
        self.size += len(key) + len(ids) + _ENTRY
        return ids


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.seen = Remembered(_REMEMBER)  # ids of chunks between blanks
        self.words = Remembered(_REMEMBER)  # ids of the pattern's pieces
        self.pieces, self.lower = _known(path)
        added = [t for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = [t.content for t in added]
        if self.lower and any(t.normalized for t in added):  # those are looked for in lower-case text
            self.pieces = None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self._by_library(text)
        return b"".join([self._slice(part) for part in _slices(text)])

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _slice(self, text: str) -> bytes:
        if self.lower:
            return self._chunks(text.lower().split(), "")
        if "  " in text or " \n" in text or "\n " in text or text[-1] == " ":
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + self._chunks(rest, " ")

    def _chunks(self, chunks: list[str], before: str) -> bytes:
        """Ids of chunks that each follow ``before``; a border of the pattern lies between any two."""
        seen = self.seen
        known = seen.make_room()
        for chunk in set(chunks).difference(known):
            seen.add(chunk, self._pieces(before + chunk))
        return b"".join([known[c] for c in chunks])

    def _pieces(self, text: str) -> bytes:
        words, tokenize = self.words, self.model.tokenize
        known = words.make_room()
        out = []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                if piece.isascii() and piece.isprintable():  # only the space has a stand-in there
                    word = piece.replace(" ", self.letters[32])
                else:
                    word = piece.encode("utf-8").decode("latin-1").translate(self.letters)
                found = [t.id for t in tokenize(word)]
                ids = words.add(piece, struct.pack(f"<{len(found)}I", *found))
            out.append(ids)
        return b"".join(out)


def _known(path: str) -> tuple[re.Pattern | None, bool]:
    """The pieces of the vocabulary's pattern, when its file asks for exactly the steps known here."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    before, normal = steps["pre_tokenizer"] or {}, steps["normalizer"] or {}
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
        return _BYTE_LEVEL, False
    parts = before.get("pretokenizers", [])
    if (
        [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not parts[1]["use_regex"]
        and not parts[1]["add_prefix_space"]
    ):
        return _WORDS, True
    return None, False


def _slices(text: str) -> Iterator[str]:
    """Pieces of bounded length, cut before a single space between two other characters: there every
    known pattern has a border."""
    at = 0
    while len(text) - at > _SLICE:
        cut = text.find(" ", at + _SLICE)
        while cut > 0 and (cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder per vocabulary and Python worker, so that later tasks find the table filled."""
    return TextEncoder(path)
