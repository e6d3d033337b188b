"""Vector codes: every part of a vector becomes its codebook's nearest entry, found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bound_batches, cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this have squared distances of 64 bits; others are computed with integers of any size.
PLAIN = 1 << 26
LARGEST = (1 << 63) - 1
#: Tables of labels of more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


class Annuli:
    """Entries in order of their norms. The distance of two vectors is at least the difference of their norms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = _norms(entries)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        #: Distances computed by the last search, of vectors times entries.
        self.evaluated = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and its squared distance.

        The entry of the nearest norm gives the first distance. Only entries whose norm differs by no more, both ends
        included, can be as near; they are an interval of the order, and all distances in it are computed.
        """
        n, k = len(vectors), len(self.entries)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = _norms(vectors)
        above = np.clip(np.searchsorted(self.norms, own), 1, k - 1) if k > 1 else np.zeros(n, np.int64)
        below = np.maximum(above - 1, 0)
        start = np.where(own - self.norms[below] <= self.norms[above] - own, below, above)
        best = self._squared(vectors, self.order[start])
        # norms are rounded: a little more is searched, never less
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-9 * (own + self.norms[-1] + 1)
        low = np.searchsorted(self.norms, own - reach, "left")
        width = np.searchsorted(self.norms, own + reach, "right") - low
        heads = np.cumsum(width) - width
        which = self.order[np.arange(width.sum()) - np.repeat(heads - low, width)]
        self.evaluated = len(which)
        found = self._squared(vectors[np.repeat(np.arange(n), width)], which)
        least = np.minimum.reduceat(found, heads)
        return np.minimum.reduceat(np.where(found == np.repeat(least, width), which, k), heads), least

    def _squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = vectors - self.entries[which]
        return (apart * apart).sum(axis=1)


def _norms(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


def _exact(vectors: np.ndarray) -> np.ndarray:
    """The integers, as Python's own where squares could leave 64 bits."""
    wide = vectors.size and (vectors.max() >= PLAIN or vectors.min() <= -PLAIN)
    return vectors.astype(object) if wide else vectors.astype(np.int64)


def _assign(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each vector its entry in each codebook and its squared distance in all; the vectors' parts."""
    parts = np.split(vectors, len(books), axis=1)
    codes, error = np.zeros((len(vectors), len(books)), np.uint8), 0
    for p, (own, book) in enumerate(zip(parts, books, strict=True)):
        codes[:, p], squared = Annuli(book).nearest(own)
        error = error + squared
    return codes, error, parts


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _sums(books: list[np.ndarray], dims: int):
    """Over rows (v): of each entry the number of its parts and the sum of each component, once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list[int]] = defaultdict(lambda: [0] * (1 + dims // len(books)))
        for b in batches:
            vectors = _exact(_matrix(b.column(0), dims))
            codes, _, parts = _assign(vectors, books)
            for p, own in enumerate(parts):
                for entry in np.unique(codes[:, p]).tolist():
                    rows = own[codes[:, p] == entry]
                    totals[p, entry] = [x + y for x, y in zip(totals[p, entry], [len(rows), *rows.sum(axis=0).tolist()], strict=True)]
        rows = [(p, e, i, n, Decimal(x)) for (p, e), (n, *sums) in totals.items() for i, x in enumerate(sums)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "place", "n", "total"])

    return run


def _encode(books: list[np.ndarray], dims: int):
    """Over rows (vec_id, label, v): vec_id, label, code, error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error, _ = _assign(_exact(_matrix(b.column(2), dims)), books)
            text = [c.tobytes().hex() for c in codes]
            error = [min(int(e), LARGEST) for e in error]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x); null if the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _trained(rows: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after all rounds. Each round reads the vectors once; of each task a row for each entry and
    component is shuffled, and no more than the codebooks' own numbers reach the driver."""
    dims = first.shape[1]
    books = [_exact(b) for b in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books, dims), "part int, entry int, place int, n long, total decimal(38,0)")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [_exact(b) for b in books]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector.

    Components become floor(scale * x), and vectors fall in `parts` equal parts. A part's codebook starts as that part
    of the vectors of the `entries` smallest vec_ids. In each round parts go to the nearest entry (squared distance,
    ties to the lower index), and entries become the floor of their parts' mean; entries without parts stay.
    code has two hex digits for each part's entry, error the squared distances in all, label_error the sum of
    errors of the label (null labels are one), codebooks_sha256 the digest of all entries' components.

    Rows whose vector is null or holds a null or a component that isn't finite go. Null vec_ids are the largest, and
    of one vec_id the smaller vector comes first; repeated rows count each. Fewer rows than entries make smaller
    codebooks; no rows give no rows; other columns are ignored. Errors beyond 64 bits are given as the
    largest number of 64. Vectors must be of one length, a multiple of `parts`; others raise an error.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col("embedding"), scale).alias("v")).filter("v is not null")
    shape = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if shape["least"] != shape["most"] or (shape["least"] or 0) % parts:
        raise ValueError(f"vectors of {shape['least']} to {shape['most']} components can't be cut into {parts} equal parts")
    dims = shape["least"] or 0
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = _trained(rows, np.array(first, np.int64).reshape(len(first), dims), parts, rounds) if first else []
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    kind = rows.schema["label"].dataType.simpleString()
    coded = cut(rows.mapInArrow(_encode(books, dims), f"vec_id long, label {kind}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LARGEST))).cast("long")
    by_label = cut(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    if by_label.count() * 64 <= BROADCAST_BYTES:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
