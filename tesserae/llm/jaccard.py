"""Exact n-gram Jaccard join: candidates share a PartEnum signature, and are confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from tesserae.llm.common import mix64
from tesserae.llm.neardup import Search

SHINGLE, PERCENT = 3, 90
#: Parts of a partition of the domain, and how many of them a signature leaves out.
SUBPARTS, SPARE = 3, 1
#: Cells of the counts by which candidates are screened.
CELLS = 248


@cache
def size_band(n: int, percent: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the band in which sets of n members are. A band's sizes differ by a factor of
    (100 / percent) ** 2 at most, so that a set's partners are in its own band or the next."""
    low, number = 1, 0
    while True:
        high = low * 10_000 // percent**2
        if n <= high:
            return number, low, high
        low, number = high + 1, number + 1


@cache
def plan(number: int, high: int, percent: int) -> tuple[int, np.ndarray]:
    """For pairs whose smaller set is of `high` members at most: the domain's first-level partitions (0: only equal sets
    are similar), and a hash for each partition and subset of its parts.

    Similar sets differ in k = high * (100 - percent) / percent members at most. Of k // (SPARE + 1) + 1 partitions one
    has SPARE of these at most. They lie in SPARE of its parts at most, and the sets agree in the others.
    """
    k = high * (100 - percent) // percent
    if not k:
        return 0, np.zeros((0, 0), np.uint64)
    partitions = k // (SPARE + 1) + 1
    subsets = len(list(combinations(range(SUBPARTS), SPARE)))
    which = np.arange(partitions * subsets, dtype=np.uint64).reshape(partitions, subsets)
    return partitions, mix64(which + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64))


def signatures(members: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of 64-bit hashes in order, in its own band and, if a partner may be smaller, in the one below."""
    n = len(members)
    number, low, high = size_band(n, percent)
    bands = [(number, high)]
    if -(-n * percent // 100) < low:
        below = size_band(low - 1, percent)
        bands.append((below[0], below[2]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(members), out=sums[1:])
    out = []
    for number, high in bands:
        partitions, salts = plan(number, high, percent)
        if partitions:
            # parts are equal ranges of the hashed domain, and members are in order
            parts = partitions * SUBPARTS
            starts = (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
            bounds = sums[np.append(np.searchsorted(members, starts), n)]
            each = (bounds[1:] - bounds[:-1]).reshape(partitions, SUBPARTS)
            kept = np.stack([each[:, [s for s in range(SUBPARTS) if s not in gone]].sum(axis=1, dtype=np.uint64) for gone in combinations(range(SUBPARTS), SPARE)], axis=1)
            out.append(mix64(kept + salts).ravel())
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


class PartEnum:
    """Signatures that every two similar sets share one of, and counts of members in cells of the domain as a screen."""

    width = 8 + CELLS

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def describe(self, sets: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """For each set its size and counts, its signatures, and nothing."""
        for a, n in zip(heads.tolist(), counts.tolist(), strict=True):
            own = sets[a : a + n]
            cells = np.minimum(np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)
            yield n.to_bytes(8, "little") + cells.tobytes(), signatures(own, self.percent), b""

    def survivors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two tables of sizes and counts that may be similar, and how near the counts are.

        Sets differ in as many members as their counts do, at least, and similar ones in a share of their sizes at most:
        no similar pair is given up.
        """
        sizes = sum(np.ascontiguousarray(x[:, :8]).view("<i8").ravel() for x in (a, b))
        apart = np.abs(a[:, 8:].astype(np.int16) - b[:, 8:]).sum(axis=1, dtype=np.int64)
        alive = np.flatnonzero(apart * (100 + self.percent) <= sizes * (100 - self.percent))
        return alive, 1_000_000 - 1_000_000 * apart[alive] // sizes[alive]


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link if 100 * intersection >= percent * union of their sets of distinct `shingle`-word shingles (A-Z
    lower-cased; fewer words make one shingle; none, no set and no links). component_id is the smallest doc_id that
    links lead to, the own included. No similar pair goes unseen: it shares a signature, the screen loses
    none, and what counts is the comparison of full sets. (Shingles are 64-bit hashes, and sets count as equal by
    128 bits.)

    Rows of equal sets are one node, however many. Null texts have no words; null doc_ids are never a component's id
    unless it has no other; rows of one doc_id are told apart; no rows give no rows; other columns are ignored.
    """
    return Search(documents, PartEnum(shingle, percent)).named().drop("text_hash")
