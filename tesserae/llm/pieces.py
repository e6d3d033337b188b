"""Sampled segmentations of texts into the pieces of a public vocabulary, and their lossless inverse."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bound_batches, mix64, slices, utf8_buffer

MODEL = "piece_bpe_32k.model"
SEED = 1
#: Exponent of the piece weights: large values sample near the best segmentation, 0 samples all alike.
THETA = 1.5

#: Lattices that a process remembers, in edges of 13 bytes.
LATTICE_EDGES = 6_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)

SPACE = 0x2581  # the vocabulary writes a space so
_LITERAL = 0x110000  # stands for that character where a text itself has it
#: No piece holds a line break, and a space only at its start: a lattice falls apart at these places.
_CHUNKS = re.compile(" +[^ \n]*|\n|[^ \n]+")


class Vocabulary:
    """Pieces as a trie in a hash table of arrays, so that many texts walk it at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        ranks, states, pieces = [], {}, [-1]
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
                continue
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
                continue
            self.bytes_of.append(piece.replace(chr(SPACE), " ").encode())
            state = 0
            for c in piece:
                key = (state << 21) | ord(c)
                if key not in states:
                    states[key] = len(pieces)
                    pieces.append(-1)
                state = states[key]
            pieces[state] = i
            ranks.append((i, -model.get_score(i)))
        self.piece_of = np.array(pieces, np.int64)
        #: Log weight of each piece: ranks in a vocabulary follow Zipf's law, so rank r weighs 1 / (r + 1).
        self.weight = np.full(n, -np.log(float(n)) - 2.0)
        for i, rank in ranks:
            self.weight[i] = -np.log1p(min(rank, float(n)))
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.longest = max(len(model.id_to_piece(i)) for i, _ in ranks)
        self._bits = max(18, int(len(states) * 6).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._next = np.zeros(1 << self._bits, np.int64)
        at = self._slot(np.fromiter(states, np.int64, len(states)))
        for slot, key in zip(at.tolist(), states, strict=True):
            while self._keys[slot] != -1:
                slot = (slot + 1) & ((1 << self._bits) - 1)
            self._keys[slot], self._next[slot] = key, states[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after reading one code each, -1 where the trie ends."""
        key = (state << 21) | code
        slot = self._slot(key)
        held = self._keys[slot]
        out = np.where(held == key, self._next[slot], -1)
        again = np.flatnonzero((held != key) & (held != -1))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self._bits) - 1)
            held = self._keys[slot[again]]
            hit = held == key[again]
            out[again[hit]] = self._next[slot[again[hit]]]
            again = again[~hit & (held != -1)]
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(name: str = MODEL) -> Vocabulary:
    if name not in _VOCABULARIES:
        import public_tokenizers

        _VOCABULARIES[name] = Vocabulary(name if "/" in name else public_tokenizers.path(name))
    return _VOCABULARIES[name]


class Lattice:
    """The piece lattices of chunks, forward-filtered.

    Lattices of the chunks met first, which are the frequent ones, stay up to LATTICE_EDGES; those of later chunks
    lie behind them until the next call.
    """

    def __init__(self, vocab: Vocabulary, theta: float):
        self.vocab, self.theta = vocab, theta
        self.number: dict[str, int] = {}
        self.chunks = self.chars = self.edges = 0
        self.starts, self.ends, self.first_edge = (np.zeros(0, np.int64) for _ in range(3))
        self.share, self.piece, self.width = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk here, until the next call."""
        found = np.fromiter(map(self.number.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        late = np.flatnonzero(found < 0)
        if len(late):
            unseen = [chunks[i] for i in late.tolist()]
            fresh = list(dict.fromkeys(unseen))
            own = dict(zip(fresh, range(self.chunks, self.chunks + len(fresh)), strict=True))
            marks = self._add(fresh)
            found[late] = list(map(own.__getitem__, unseen))
            if marks[-1] <= LATTICE_EDGES:
                self.number.update(own)
                self.chunks, self.chars, self.edges = marks
        return found

    def _add(self, chunks: list[str]) -> tuple[int, int, int]:
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(codes == SPACE, _LITERAL, np.where(codes == 0x20, SPACE, codes))
        ends = np.cumsum(size)
        first, share, piece, width = _filter_forward(self.vocab, codes, ends - size, ends, self.theta)
        for name, at, values in (
            ("starts", self.chunks, ends - size + self.chars), ("ends", self.chunks, ends + self.chars), ("first_edge", self.chars, first + self.edges),
            ("share", self.edges, share), ("piece", self.edges, piece), ("width", self.edges, width),
        ):
            held = getattr(self, name)
            if at + len(values) > len(held):
                grown = np.empty((at + len(values)) * 5 // 4, held.dtype)
                grown[:at] = held[:at]
                setattr(self, name, held := grown)
            held[at : at + len(values)] = values
        return self.chunks + len(chunks), self.chars + len(codes), self.edges + len(share)

    def sample(self, kind: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward-sample one path for each occurrence of a chunk: all pieces in order, and how many each has.

        kind: the chunk of each occurrence; seed: its row's; place: of its first character in the row. The
        random number of a choice depends on the seed and the place in the row alone.
        """
        n = len(kind)
        count = np.zeros(n, np.int64)
        low = self.starts[kind]
        active, node = np.arange(n), self.ends[kind] - 1
        # the place in the row of a node, times the constant, is that of its chunk plus that of the node
        start = seed + (place - low).astype(np.uint64) * _STEP
        steps = []
        while len(active):
            u = (mix64(start[active] + node.astype(np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first_edge[node]
            late = np.flatnonzero(u >= self.share[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.share[edge[late]]]
            steps.append((active, self.piece[edge]))
            count[active] += 1
            node = node - self.width[edge]
            more = node >= low[active]
            active, node = active[more], node[more]
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, piece) in enumerate(steps):
            out[last[who] - k] = piece
        return out, count


def _filter_forward(vocab: Vocabulary, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, theta: float) -> tuple[np.ndarray, ...]:
    """For each character its first incoming edge; for each edge the running share of its node, its piece and its length.

    Nodes are the characters; an edge is a piece that ends there. They are numbered by their place in their chunk first,
    so that one round of the loop sums the weights of all paths to the k-th characters of all chunks.
    """
    n = len(codes)
    level = np.arange(n) - np.repeat(starts, ends - starts)
    limit = np.repeat(ends, ends - starts)
    top_level = int(level.max(initial=0))
    by_level = np.argsort(level.astype(np.uint16 if top_level < 1 << 16 else np.int64), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_level] = np.arange(n)
    at, state = by_level, np.zeros(n, np.int64)
    lone = np.ones(n, bool)
    edges = []
    for k in range(vocab.longest):
        inside = at + k < limit[at]
        at, state = at[inside], state[inside]
        state = vocab.step(state, codes[at + k])
        alive = state >= 0
        at, state = at[alive], state[alive]
        if not len(at):
            break
        piece = vocab.piece_of[state]
        some = piece >= 0
        edges.append((at[some], rank[at[some] + k], piece[some], np.full(int(some.sum()), k + 1, np.uint8)))
        if k == 0:
            lone[at[some]] = False
    # a character that is no piece is spelt in bytes: one edge, numbered below zero by the character
    spelt = by_level[lone[by_level]]
    edges.insert(0, (spelt, rank[spelt], -1 - codes[spelt], np.ones(len(spelt), np.uint8)))
    begin, stop, piece, width = (np.concatenate(c) for c in zip(*edges[::-1], strict=True))  # longer pieces begin earlier
    order = np.argsort(stop, kind="stable")  # each length's nodes are in order already: a merge of few runs
    begin, stop, piece, width = begin[order], stop[order], piece[order], width[order]
    weight = theta * np.where(piece >= 0, vocab.weight[np.maximum(piece, 0)], 2 * vocab.weight[0])
    count = np.bincount(stop, minlength=n)
    first = np.cumsum(count) - count
    source = np.where(level[begin] == 0, n, rank[begin - 1])
    alpha, total, share = np.zeros(n + 1), np.empty(n), np.empty(len(begin))
    rounds = np.cumsum(np.bincount(level, minlength=top_level + 1)) if n else np.zeros(0, np.int64)
    for a, b in zip([0, *rounds[:-1].tolist()], rounds.tolist(), strict=True):
        lo, hi = int(first[a]), int(first[b]) if b < n else len(begin)
        value = alpha[source[lo:hi]] + weight[lo:hi]
        heads = first[a:b] - lo
        top = np.maximum.reduceat(value, heads)
        mass = np.exp(value - np.repeat(top, count[a:b]))
        total[a:b] = np.add.reduceat(mass, heads)
        alpha[a:b] = top + np.log(total[a:b])
        share[lo:hi] = mass
    share /= np.repeat(total, count)
    # running sums within each node, by the place of an edge in it
    nodes = np.flatnonzero(count > 1)
    k = 1
    while len(nodes):
        share[first[nodes] + k] += share[first[nodes] + k - 1]
        k += 1
        nodes = nodes[count[nodes] > k]
    share[first + count - 1] = 2.0  # the last edge of a node takes what rounding leaves
    return first[rank], share, piece, width


def _spell(vocab: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace edges of single characters by their bytes' pieces."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, count
    spelt = [chr(SPACE if c == _LITERAL else c).encode() for c in (-1 - ids[odd]).tolist()]
    width = np.ones(len(ids), np.int64)
    width[odd] = [len(b) for b in spelt]
    owner = np.repeat(np.arange(len(count)), count)
    out = np.repeat(ids, width)
    at = np.cumsum(width)[odd] - width[odd]
    for a, b in zip(at.tolist(), spelt, strict=True):
        out[a : a + len(b)] = vocab.byte_id[list(b)]
    return out, np.bincount(owner, weights=width, minlength=len(count)).astype(np.int64)


_LATTICES: dict[tuple[int, float], Lattice] = {}


def _lattice(vocab: Vocabulary, theta: float) -> Lattice:
    """The lattices that this process has built so far."""
    return _LATTICES.setdefault((id(vocab), theta), Lattice(vocab, theta))


def _sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and how many each has."""
    chunks, per_text = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = _CHUNKS.findall(" " + t)
        chunks += own
        per_text[i] = len(own)
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    lattice = _lattice(vocab, theta)
    kind = lattice.numbers(chunks)
    owner = np.repeat(np.arange(len(texts)), per_text)
    length = (lattice.ends - lattice.starts)[kind]
    through = np.cumsum(length) - length
    begin = np.cumsum(per_text) - per_text
    places = through - through[np.minimum(begin, len(through) - 1)][owner]
    seeds = mix64(mix64(keys.astype(np.uint64) + np.uint64(seed)))
    ids, count = lattice.sample(kind, seeds[owner], places)
    ids, count = _spell(vocab, ids, count)
    return ids, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def sample_texts(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int = SEED, theta: float = THETA) -> list[np.ndarray]:
    """A sampled segmentation of each text; equal keys and texts give equal ones, wherever they are computed."""
    ids, totals = _sample(texts, keys, vocab, seed, theta)
    return np.split(ids, np.cumsum(totals)[:-1])


def decode_bytes(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces end to end, and where each piece ends in them."""
    size = vocab.size_of[ids]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(vocab.start_of[ids] - (ends - size), size)
    return vocab.all_bytes[place], ends


def decode_ids(ids: Iterable[int], vocab: Vocabulary) -> str:
    """The text of a segmentation, exactly: pieces hold all of its characters and one more space in front."""
    return decode_bytes(np.fromiter(ids, np.int64), vocab)[0].tobytes().decode()[1:]


def _encoder(model: str, seed: int, theta: float, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for b in slices(iter(batches), limit=4 << 20):  # the more, the more chunks occur again
            texts = b.column(1).to_pylist()
            keys = np.array([k or 0 for k in b.column(0).to_pylist()], dtype=np.int64)
            ids, count = _sample([t or "" for t in texts], keys, vocab, seed, theta)
            stops = np.cumsum(count)
            if not digest:
                lists = [None if t is None else i for t, i in zip(texts, np.split(ids, stops[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                continue
            raw, offsets = utf8_buffer(b.column(1))
            back, ends = decode_bytes(ids, vocab)
            ends = np.append(0, ends)
            data = ids.astype("<u4").tobytes()
            rows = []
            for i, (t, a, z) in enumerate(zip(texts, (stops - count).tolist(), stops.tolist(), strict=True)):
                own = back[ends[a] + 1 : ends[z]]  # behind the space in front
                if t is None:
                    rows.append((0, 0, 0, True))
                else:
                    same = np.array_equal(own, raw[offsets[i] : offsets[i + 1]])
                    rows.append((z - a, zlib.crc32(data[4 * a : 4 * z]), zlib.crc32(own.tobytes()), same))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "lossless"])

    return run


def encode(documents: DataFrame, seed: int = SEED, theta: float = THETA, model: str = MODEL) -> DataFrame:
    """doc_id and the ids of one segmentation, drawn with the probability that its pieces' weights give it.

    Forward filtering sums the weights of all paths to each place of the lattice, backward sampling draws pieces
    from the end. Random numbers depend on seed, doc_id and place only. A null text has null ids, an empty one
    the lone space piece; a null doc_id counts as 0; equal rows give equal ids; other columns are not read.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoder(model, seed, theta, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text. decode(encode(x)) is x, whatever x holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for b in batches:
            texts = [None if i is None else decode_ids(i, vocab) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(documents: DataFrame, seed: int = SEED, theta: float = THETA, model: str = MODEL) -> DataFrame:
    """encode and decode in one pass: n_ids, ids_crc32, the decoded text's crc32, and whether it is the text.

    A null text has no ids, both crc32 are 0 and it counts as lossless; an empty one has the lone space piece. Rows with
    equal doc_id and text give equal rows; a null doc_id counts as 0; no rows give no rows; other columns are not read.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoder(model, seed, theta, True), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean")
