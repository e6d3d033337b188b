import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@pytest.mark.parametrize("text", ["", "it's don't we're 'story ''s !!'s x'", "<|endoftext|> a", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "é <|endoftext|>中", "a1b22 ...;; É", "ß STRASSE ÀÉ", "é  x İ ﬁ 中文", "a\r\nb\tc"])
def test_word_cache_equals_the_tokenizer(tokenizer, text):
    got = np.frombuffer(packing.encoder(packing.TOKENIZER).encode([text])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_may_overflow(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    e = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    for text in ("one two three four five", "six seven one", "two eight nine ten", "one"):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bins,partitions", [(4, 1), (256, 3)])
def test_pieces_and_places(docs, corpus, tokenizer, bins, partitions):
    capacity = 64
    rows = packing.pack_documents(docs(corpus).repartition(partitions), capacity=capacity, bins=bins).collect()
    want = {}
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, k] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.1 * -(-sum(n for _, n, _ in want.values()) // capacity) + 1


def test_fullest_bin_closes_first():
    p = packing.BestFit(10, 2, iter(range(9)))
    assert [p.place(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # bin 1 was fuller than 0 and closed
    assert p.place(4) == (0, 6)
    assert p.place(2) == (2, 8)


def test_left_over_bins_share_sequences(spark):
    """Many small partitions, each far from filling a bin, still give nearly the fewest sequences."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(n)), "x") for i, n in enumerate(rng.integers(1, 40, 600))]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, tail string").repartition(8), capacity=64, bins=16)
    tokens, used = out.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used <= 1.12 * -(-tokens // 64) + 1
