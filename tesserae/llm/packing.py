"""Packing of tokenised documents into sequences of bounded length, by bounded-space best fit."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, slices

TOKENIZER = "word_bpe_49k.json"
#: Bins that one packer keeps open. Memory and time of a packer depend on it, not on the rows.
OPEN_BINS = 256
#: Bins that a packer holds at the end stay as they are from this fill on; the others are packed again together with
#: other packers', about so many pieces in a group.
FULL_ENOUGH, TAIL_PIECES = 0.98, 2_500
#: Encoded words that a worker remembers.
CACHE_WORDS = 350_000

#: Characters whose normal form is themselves or their lower case, whatever stands beside them.
_PLAIN = re.compile("[\n\r\t\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own pre-tokenisation, for texts of such characters in lower case.
_PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit words, with a memory of words seen before.

    The tokenizer splits a text into pretokens and encodes each by itself, so for plain texts the ids of
    the pretokens are joined. Any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with these strings go to the tokenizer whole, which gives them ids of their own.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of pretokens, which are encoded side by side: the last id of each is one that ends words."""
        lines = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        data = ids.tobytes()
        return (data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > CACHE_WORDS:  # words that came early are the frequent ones
            self.seen = dict(itertools.islice(self.seen.items(), CACHE_WORDS // 4))
        split = [_PRETOKENS.findall(t.lower()) if _PLAIN.fullmatch(t) and not any(a in t for a in self.added) else None for t in texts]
        known = self.seen.get
        ids = [None if w is None else list(map(known, w)) for w in split]
        unseen: dict[str, None] = {}
        late = [i for i, got in enumerate(ids) if got is not None and None in got]
        for i in late:
            unseen.update(dict.fromkeys(w for w, got in zip(split[i], ids[i], strict=True) if got is None))
        if unseen:
            words = list(unseen)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                self.seen.update(zip(part, self._encode_words(part), strict=True))
        for i in late:
            ids[i] = list(map(self.seen.__getitem__, split[i]))
        whole = iter(self._encode([t for t, w in zip(texts, split, strict=True) if w is None]))
        return [next(whole) if got is None else b"".join(got) for got in ids]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    if name not in _ENCODERS:
        import os

        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[name] = WordEncoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]


class BestFit:
    """Online best fit with at most `bins` open bins.

    Bit f of `mask` is set if an open bin has f tokens free; the least such f that holds a piece is one
    shift and one isolated low bit away. When a new bin is needed and all are open, the fullest closes.
    """

    def __init__(self, capacity: int, bins: int, ids: Iterator[int]):
        self.capacity, self.bins, self.ids = capacity, bins, ids
        self.mask, self.count = 0, 0
        self.free: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        own = self.free[space]
        bin_id = own.pop()
        if not own:
            del self.free[space]
            self.mask ^= 1 << space
        self.count -= 1
        return bin_id

    def _put(self, bin_id: int, space: int) -> None:
        if space:
            self.free.setdefault(space, []).append(bin_id)
            self.mask |= 1 << space
            self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.count >= self.bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            bin_id, space = next(self.ids), self.capacity
        self._put(bin_id, space - length)
        return bin_id, self.capacity - space

    def open_bins(self) -> set[int]:
        return {b for own in self.free.values() for b in own}


def _packer(capacity: int, bins: int, tokenizer: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = BestFit(capacity, bins, itertools.count(part << 40))
        encode = encoder(tokenizer).encode
        held: dict[int, list[tuple]] = {}
        full = lambda own: sum(r[3] for r in own) >= FULL_ENOUGH * capacity
        schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")] + [("tail", pa.bool_())])

        def batch(rows: list[tuple], tail: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)] + [pa.array([tail] * len(rows))], schema=schema)

        for piece_rows in slices(iter(batches), limit=2 << 20):
            for doc_id, ids in zip(piece_rows.column(0).to_pylist(), encode(["" if t is None else t for t in piece_rows.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    bin_id, offset = packer.place(length)
                    held.setdefault(bin_id, []).append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), bin_id, offset))
            still = packer.open_bins()
            closed = [b for b in held if b not in still]
            if closed:
                yield batch([r for b in closed for r in held.pop(b)], False)
        for tail in (False, True):
            rest = [r for own in held.values() if full(own) != tail for r in own]
            if rest:
                yield batch(rest, tail)

    return run


def _repack(capacity: int, bins: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The same bounded packer over the left-over bins of some packers, longest pieces first."""
        lengths = rows.column("length").to_pylist()
        packer = BestFit(capacity, bins, itertools.count((1 << 62) + (key[0].as_py() << 40)))
        ids, offsets = [0] * len(lengths), [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            ids[i], offsets[i] = packer.place(lengths[i])
        return rows.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack_documents(documents: DataFrame, capacity: int = 4096, bins: int = OPEN_BINS, tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there.

    A document's ids are those that the tokenizer gives its whole text (null: none), and `end_id`. Only documents of
    more than `capacity` ids are cut. Each partition is packed as it streams by; of the bins that its packer still
    holds at the end, a bounded number, those that are not nearly full are packed again with others', by the same
    bounded packer.
    Rows with equal or null doc_id are packed one by one; no rows give no rows; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    placed = cut(rows.mapInArrow(_packer(capacity, bins, tokenizer, end_id), PIECES + ", tail boolean"), "packed")
    tails = placed.filter("tail").drop("tail")
    groups = max(1, round(tails.count() / TAIL_PIECES))
    again = tails.groupBy(F.expr(f"cast(pmod(sequence_id >> 40, {groups}) as long)").alias("g")).applyInArrow(_repack(capacity, bins), PIECES)
    return placed.filter("not tail").drop("tail").unionByName(again)
