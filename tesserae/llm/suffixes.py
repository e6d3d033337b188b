"""Removal of repeated 100-byte strings, by column-wise construction over many documents at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut, mix64, powers, prefix_hashes, slices, utf8_buffer

#: Bytes of the strings that may not repeat, and of the grams by which their places are found.
LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1  # grams in one string
#: Segments that one construction takes in, and those of one anchor for which it has one more part.
COLLECTION, GROUP = 60_000, 1_000
#: Stands for a null doc_id, which sorts before all others.
NO_DOC = -(1 << 63)

ANCHORS = "f long, h long, doc long, tag long, pos long, mark boolean"
MARK, SEGMENT = 0, 1


def pack(start: np.ndarray, run: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Start, windows - 1 (7 bits) and anchor - start (7 bits) in one long that sorts by start."""
    return (start << 14) | (run << 7) | anchor


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 14, (pos >> 7) & 127, pos & 127


def _sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the least of each w neighbours, the first of equals."""
    n = len(x) - w + 1
    place = np.arange(len(x))
    # the low half of the values gives way to places, so that minima carry theirs along
    keyed = ((x >> np.uint64(32)) << np.uint64(32)) | place.astype(np.uint64)
    pad = -len(x) % w
    blocks = np.concatenate([keyed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For the texts of a buffer: gram hash, content hash, text index, first and last window, anchor of each segment.

    Every window of `length` bytes has an anchor: the gram of least hash in it. Windows in a row with one anchor form
    a segment. Equal windows have equal anchors at equal offsets, so they lie in segments of one gram hash.
    """
    reach = length - GRAM + 1
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 6
    sums = prefix_hashes(raw)
    _, down = powers(len(raw) + 1)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])
    anchor = _sliding_argmin(grams, reach)
    window = np.arange(len(anchor))
    text = np.searchsorted(offsets, window, side="right") - 1
    inside = window + length <= offsets[text + 1]
    opens = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(opens)
    stops = np.flatnonzero(np.concatenate([opens[1:] | ~inside[1:], [True]]))
    last = stops[np.searchsorted(stops, first)]
    content = mix64((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return grams[anchor[first]].view(np.int64), content.view(np.int64), text[first], first, last, anchor[first]


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _anchors(length: int):
    schema = pa.schema([(n, pa.int64()) for n in ("f", "h", "doc", "tag", "pos")] + [("mark", pa.bool_())])

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Of equal segments in this task the first one competes with other tasks'; the rest do repeat it."""
        f, h, doc, tag, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, tag, doc, h, f))
        f, h, doc, tag, pos = f[order], h[order], doc[order], tag[order], pos[order]
        lead = np.flatnonzero(_changes(f, h))
        leader = np.repeat(lead, np.diff(np.append(lead, len(f))))
        mark = (doc != doc[leader]) | (tag != tag[leader]) | (pos != pos[leader])
        keep = mark.copy()
        keep[lead] = True  # a repeated row with the same doc_id and text is the same occurrence
        f = np.where(mark, mix64(tag.astype(np.uint64) + pos.astype(np.uint64)).view(np.int64), f)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (f, np.where(mark, 0, h), doc, tag, pos)] + [pa.array(mark[keep])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in slices(iter(batches), limit=256 << 10):  # some dozen bytes are held for each of these
            raw, offsets = utf8_buffer(b.column(b.schema.get_field_index("text")))
            docs, tags = (np.asarray(b.column(b.schema.get_field_index(n)), dtype=np.int64) for n in ("doc", "tag"))
            f, h, text, first, last, anchor = segments(raw, offsets, length)
            if len(f):
                held.append((f, h, docs[text], tags[text], pack(first - offsets[text], last - first, anchor - first)))
                size += len(f)
            if size > 300_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def positional_bwt(strings: list[bytes], anchors: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Insert one symbol of every string each round, from the last column to the first.

    Strings are aligned at their anchors: column reach - 1 holds the anchor's first byte. Before a round the strings
    are in order of what follows the column; a stable distribution by the new symbol (the LF step) gives the order
    from the column on. The symbols in that order are the column's part of the collection's Burrows-Wheeler
    transform. The common prefix of two neighbours is one more than the least one between their former
    places if their symbols agree, else 0. Yields (column, order, common prefix with the neighbour above).
    """
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    width = int((reach - 1 - anchors + size).max(initial=0))
    # one file of symbols per column, read once each in sequence; 0: the string has no symbol here
    columns = np.zeros((width, n), np.uint16)
    owner = np.repeat(np.arange(n), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(reach - 1 - anchors, size)
    columns[place, owner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for c in range(width - 1, -1, -1):
        symbol = columns[c, order]
        step = np.argsort(symbol, kind="stable")
        ends = np.cumsum(np.bincount(symbol, minlength=257))
        fresh = np.zeros(n, np.uint8)
        for a, b in zip(ends[:-1], ends[1:], strict=True):  # symbol 0 agrees with nothing
            if b - a > 1:
                at = step[a:b]
                fresh[a + 1 : b] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) + 1
        order, common = order[step], fresh
        yield c, order, common


def repeated_windows(strings: list[bytes], anchors: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and column: whether the window that starts there also starts in a string of smaller rank."""
    reach = length - GRAM + 1
    out = np.zeros((len(strings), reach), bool)
    for c, order, common in positional_bwt(strings, anchors, reach):
        if c >= reach:
            continue
        heads = common < length
        if heads.all():
            continue
        lead = np.flatnonzero(heads)
        least = np.minimum.reduceat(rank[order], lead)
        out[order, c] = rank[order] > np.repeat(least, np.diff(np.append(lead, len(order))))
    return out


def _construct(length: int, collection: int):
    reach = length - GRAM + 1
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64())])

    def solve(f: list, docs: list, tags: list, poss: list, strings: list) -> pa.RecordBatch:
        doc, tag, pos = (np.array(x, np.int64) for x in (docs, tags, poss))
        start, _, anchor = unpack(pos)
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((start + anchor, tag, doc))] = np.arange(len(doc))
        again = repeated_windows(strings, anchor, rank, length)
        # runs of repeated windows, as packed segments of their own
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, first = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        begin = start[who] + anchor[who] - (reach - 1) + first
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(tag[who]), pa.array(pack(begin, end - first - 1, np.zeros(len(who), np.int64)))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held[0] and row[:4] == tuple(own[-1] for own in held[:4]):  # repeated rows, of several tasks
                    continue
                if len(held[0]) >= collection and row[0] != held[0][-1]:
                    yield solve(*held)
                    held = ([], [], [], [], [])
                for own, x in zip(held, row, strict=True):
                    own.append(x)
        if held[0]:
            yield solve(*held)

    return run


def _cut_out(length: int):
    """Bytes of segments, from rows of a text and its packed segments, each cut into `parts` by the place of the anchor.

    The windows of a part hold the anchor at one of some neighbouring places, so that equal ones agree in all bytes
    between the first's end and the last's start. Parts are dealt by the hash of these bytes (f).
    """
    schema = pa.schema([("f", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64()), ("bytes", pa.binary())])
    reach = length - GRAM + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            out: list[tuple] = []
            for doc, tag, text, own in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc", "tag", "text", "own")), strict=True):
                if (doc, tag) in seen:  # a repeated row
                    continue
                seen.add((doc, tag))
                data = text.encode()
                for x in own:
                    start, more, anchor = unpack(x["pos"])
                    width = -(-reach // x["parts"])
                    for low in range((anchor - more) // width * width, anchor + 1, width):
                        first, last = start + max(0, anchor - low - width + 1), start + min(more, anchor - low)
                        at = start + anchor
                        shared = data[at - low : max(at + GRAM, at - low - width + 1 + length)]
                        f = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=low.to_bytes(2, "little")).digest(), "little", signed=True)
                        out.append((f, doc, tag, pack(first, last - first, at - first), data[first : last + length]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each document, merged where they touch, as pairs of 64-bit numbers."""
    for b in batches:
        ranges = []
        for own in b.column(2).to_pylist():
            start, run_, _ = unpack(np.sort(np.array(own, np.int64)))
            reach = np.maximum.accumulate(start + run_)
            heads = np.concatenate([[True], start[1:] > reach[:-1] + 1])
            lead = np.flatnonzero(heads)
            ranges.append(np.stack([start[lead], np.append(reach[lead[1:] - 1], reach[-1])], axis=1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranges, pa.binary())], names=["r_doc", "r_tag", "ranges"])


#: Tables of more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, collection: int = COLLECTION, group: float = GROUP) -> DataFrame:
    """(r_doc, r_tag, ranges): first and last start of each run of windows that also start earlier.

    keyed: doc, tag, text; rows with one doc and tag are one text. Segments meet by the hash of their anchor. Of equal segments all but the first
    are repeats throughout; one string stands for them in the construction, which the segments that share
    an anchor with a different one enter. They enter it in parts, the more parts the more there are: equal windows
    lie in parts that also agree in the symbols beside the anchor, so a common anchor is split by these.
    """
    anchors = keyed.filter(F.octet_length("text") >= length).select("doc", "tag", "text").mapInArrow(_anchors(length), ANCHORS)
    equal = Window.partitionBy("f", "h").orderBy("doc", "tag", "pos")
    ranked = (
        anchors.repartition("f")
        .withColumn("place", F.dense_rank().over(equal))
        .withColumn("first", ((F.row_number().over(equal) == 1) & ~F.col("mark")).cast("int"))
        .withColumn("others", F.sum("first").over(Window.partitionBy("f")))
    )
    kind = F.when(F.col("mark") | (F.col("place") > 1), MARK).when((F.col("first") == 1) & (F.col("others") > 1), SEGMENT)
    parts = F.least(F.lit(length - GRAM + 1), 2 + F.col("others") / group).cast("int")
    found = cut(ranked.select(kind.alias("kind"), "doc", "tag", "pos", parts.alias("parts")).filter("kind is not null"), "found", ["kind"])
    marks = found.filter(F.col("kind") == MARK).select("doc", "tag", "pos")
    own = found.filter(F.col("kind") == SEGMENT).groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "parts")).alias("own"))
    needed = cut(own, "needed")
    some = keyed.join(_small(needed.select("doc").distinct(), 16 * needed.count()), "doc", "left_semi")
    strings = some.join(needed, ["doc", "tag"]).mapInArrow(_cut_out(length), "f long, doc long, tag long, pos long, bytes binary")
    ordered = strings.repartition("f").sortWithinPartitions("f", "doc", "tag", "pos")
    marks = marks.unionByName(ordered.mapInArrow(_construct(length, collection), "doc long, tag long, pos long"))
    each = marks.groupBy("doc", "tag").agg(F.collect_list("pos").alias("own"))
    return cut(each.mapInArrow(_merge, "r_doc long, r_tag long, ranges binary"), "ranges")


def _remove(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index
            out = []
            for data, ranges in zip(b.column(at("text")).cast(pa.binary()).to_pylist(), b.column(at("ranges")).to_pylist(), strict=True):
                data = data or b""
                spans: list[list[int]] = []
                for first, last in np.frombuffer(ranges or b"", "<i8").reshape(-1, 2).tolist():
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                kept, end = [], 0
                for s, e in spans:
                    kept.append(data[end:s])
                    end = e
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            n_bytes, removed, spans_, digest, text = zip(*out, strict=True)
            columns = [b.column(i) for i in range(b.num_columns)]
            names = list(b.schema.names)
            columns[at("text")], columns[at("ranges")] = pa.array(text, pa.string()), pa.array(n_bytes, pa.int64())
            names[at("text")], names[at("ranges")] = "kept_text", "n_bytes"
            extra = [pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + extra, names=[*names, "n_removed", "n_spans", "kept_sha256"])

    return run


RESULT = "kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _without_repeats(documents: DataFrame, rest: list[str], length: int) -> DataFrame:
    """Columns doc, row (the columns `rest`) and RESULT."""
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    keyed = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        row.alias("row"),
    ).withColumn("tag", F.xxhash64("text"))
    ranges = repeated_ranges(keyed.select("doc", "tag", "text"), length)
    rows, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ranges")), F.lit(0))).first()
    joined = keyed.join(_small(ranges, 32 * rows + size), (F.col("doc") == F.col("r_doc")) & (F.col("tag") == F.col("r_tag")), "left")
    return joined.select("doc", "row", "text", "ranges").mapInArrow(_remove(length), f"doc long, row {keyed.schema['row'].dataType.simpleString()}, {RESULT}")


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept_text, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Each byte goes that a `length`-byte string covers which also starts earlier: in a document of smaller doc_id, or
    before in its own. Strings are those of the input texts in UTF-8 and never cross documents; null texts
    are empty and come back so. kept_text leaves out what a cut leaves of a character. A null doc_id is the smallest;
    rows of one doc_id with different texts count as documents in a fixed order, such rows with equal texts
    as one, each of them returned. No rows give no rows; columns of other names are ignored.
    """
    done = _without_repeats(documents, [], length)
    return done.select(F.when(F.col("doc") != NO_DOC, F.col("doc")).alias("doc_id"), "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what remove_repeats() leaves of their texts, and n_chars (if there) to match."""
    done = _without_repeats(documents, [c for c in documents.columns if c != "text"], length)
    own = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
