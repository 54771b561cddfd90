"""Encoding, token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm import tokens
from matchloom.llm.packing import pack, pack_documents, packing_patterns, sequences, token_pieces
from matchloom.llm.token_store import END, fetch, read_token_store, write_token_store
from matchloom.llm.tokens import TextEncoder, tokenizer_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", "'s", "it's don't IT'S we'll x'd", "a  b", "  a", "a \n b\n\nc  ", "<|endoftext|> hi <|startoftext|>", "İstanbul ŉ ſ ı", "naïve café",
    "日本語 テキスト", "ΣΑΣ", "x_y __ a_1 12345 6.7", "²³½ ª º µ", "\t tab", "a b", "é", "\x1c\x1d", "&&& %%%", " ", "x ", "\n",
    "ab" * 1000, "  's", "¿Qué? «bien» ×÷", "Ⅷ ǅ", "a\n", "\n a", "a\n\n b", "1 23", "<|x", "𝔘 🎉🎉",
]


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(params=NAMES)
def pair(request):
    encoder = TextEncoder(tokenizer_path(request.param))
    return encoder, encoder.library


def test_encoder_equals_library(pair, monkeypatch):
    encoder, library = pair
    rng = random.Random(1)
    letters = "aB'sdré 1_.\n \téß²İΣ&<|é"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    assert [encoder.encode(t) for t in texts] == [ids(library, t) for t in texts]
    assert encoder.encode(None) == b""
    monkeypatch.setattr(tokens, "_SLICE", 50)
    monkeypatch.setattr(tokens, "_REMEMBER", 20)
    long = " ".join(rng.choice(["word", "tail's", "x\ny", " ", "Élan"]) for _ in range(2000))
    assert encoder.encode(long) == ids(library, long)


@pytest.mark.parametrize("name", NAMES)
def test_strings_of_added_tokens(name):
    plain, encoder = Tokenizer.from_file(tokenizer_path(name)), TextEncoder(tokenizer_path(name))
    texts = ["end <|endoftext|> hi", "<|endoftext|>", "a<|startoftext|>b", "x <|ENDOFTEXT|> y", "<|endoftext|", "日本 <|endoftext|>", "\n<|endoftext|>  <|endoftext|> "]
    texts += ODD + ["word " * 60000 + "<|endoftext|>" + " word" * 60000]
    assert [encoder.encode(t) for t in texts] == [ids(plain, t) for t in texts]
    end = plain.token_to_id("<|endoftext|>")
    assert np.frombuffer(encoder.encode(texts[0]), "<u4").tolist().count(end) == 1


ROWS = [(3, "the cat sat"), (1, "a b c " * 4000), (2, None), (None, "no id"), (5, ""), (4, "copy"), (4, "copy"), (-7, "Ünïcode 日本")]


def test_token_store_round_trip(spark, docs_of, tmp_path):
    path, library = f"{tmp_path}/store", Tokenizer.from_file(tokenizer_path(NAMES[0]))
    more = [(i, f"filler text number {i} " * (i % 9)) for i in range(100, 400)]
    write_token_store(docs_of(ROWS + more).repartition(4), path, tokenizer_path(NAMES[0]))
    got = read_token_store(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(ROWS + more, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r, (_, text) in zip(got, rows):
        want = ids(library, text) + np.array([END], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want) // 4, zlib.crc32(want))
        assert np.array(r.ids, "<u4").tobytes() == want
        start += r.n_tokens
    for doc_id in (1, 3, 333):
        found = fetch(spark, path, doc_id).collect()
        assert [list(f.ids) for f in found] == [list(r.ids) for r in got if r.doc_id == doc_id]
    assert fetch(spark, path, 12345).count() == 0
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.select("dictionary_hash").distinct().count() == 1


def test_token_store_of_nothing(spark, docs_of, tmp_path):
    write_token_store(docs_of([]), f"{tmp_path}/empty", tokenizer_path(NAMES[0]))
    assert read_token_store(spark, f"{tmp_path}/empty").count() == 0


def check_packing(packed, capacity):
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_pack_documents(docs_of):
    library = Tokenizer.from_file(tokenizer_path(NAMES[1]))
    rng = random.Random(2)
    rows = ROWS + [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.randint(0, 60)))) for i in range(1000, 1200)]
    packed = pack_documents(docs_of(rows), tokenizer_path(NAMES[1]), capacity=64, with_ids=True)
    got = packed.collect()
    check_packing(got, 64)
    whole = {}
    for doc_id, text in rows:
        want = ids(library, text) + np.array([1], "<u4").tobytes()
        for at in range(0, len(want), 256):
            key = (doc_id, at // 4, len(want[at : at + 256]) // 4, zlib.crc32(want[at : at + 256]), len(want) // 4)
            whole[key] = whole.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        found[key] = found.get(key, 0) + 1
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert found == whole
    built = sequences(packed).collect()
    assert sum(len(s.ids) for s in built) == sum(r.length for r in got) and max(len(s.ids) for s in built) <= 64
    assert pack_documents(docs_of([]), tokenizer_path(NAMES[1])).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for _ in range(60):
        histogram = {length: rng.randint(1, 400) for length in rng.sample(range(1, 65), rng.randint(1, 40))}
        patterns = packing_patterns(histogram, 64)
        held = {}
        for count, pattern in patterns:
            assert count > 0 and sum(length * n for length, n in pattern) <= 64
            for length, n in pattern:
                held[length] = held.get(length, 0) + count * n
        assert held == histogram
        total = sum(k * v for k, v in histogram.items())
        assert sum(c for c, _ in patterns) <= -(-total // 64) * 2 + 1


def test_pack_is_tight_with_many_lengths(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.randint(1, 2048), i, 1) for i in range(5000)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    by_sequence = check_packing(pack(pieces, 2048).collect(), 2048)
    assert sum(r[2] for r in rows) / (2048 * len(by_sequence)) > 0.98


def test_pieces_without_ids(docs_of):
    assert token_pieces(docs_of([(1, None)]), tokenizer_path(NAMES[1])).collect()[0][:3] == (1, 0, 1)
