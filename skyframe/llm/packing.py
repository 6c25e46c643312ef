"""Best-fit packing with large-item matching.

The plan is made for lengths, not documents: there are at most `capacity` different lengths, so the histogram of
the whole corpus fits on the driver at any size.  Items above a third of the capacity, of which a bin holds two at
most, are paired greedily (longest first, each with the longest that still fits); smaller ones go, longest first,
into the tightest gap that holds them.  Equal lengths are placed by one step, so a step is a rule "items of length
s with ranks r.. fill bins b.. from offset o, q to a bin"; documents then look up their rule by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, staged
from .tokens import encoded, give_back

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, text) -> one row for each piece of at most `capacity` ids; null text is an empty text.

    Only longer documents are cut; their first piece takes what does not fill a whole one.
    """

    def run(batches):
        yield from pieces_of(batches, tokenizer, end_id, capacity)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pieces_of(batches, tokenizer: str, end_id: int, capacity: int, most: int = 1 << 20):
    """The rows of token_pieces() for a task's batches, of which `most` bytes of text are worked on at a time."""
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        names = batch.column("doc_id").to_pylist()
        for i, ids in encoded(tokenizer, batch.column("text"), most):
            ids += end
            n = len(ids) // 4
            at, k, size = 0, 0, n % capacity or min(n, capacity)
            while at < n:
                rows.append((names[i], k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                at, k, size = at + size, k + 1, capacity
        cols = list(zip(*rows)) or [[]] * 5
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del batch, names, rows, cols
    give_back()


class Plan:
    """Rules (length, first rank, items, first bin, items a bin, offset) for a histogram {length: items}."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.bins, self.rules = capacity, 0, []
        self.left = {s: n for s, n in sorted(histogram.items()) if n}
        self.rank = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins) of bins that have it
        self.sizes: list[int] = []  # the gaps, ascending
        self._match_large()
        self._fill_small()

    def _put(self, size: int, items: int, first: int, each: int, offset: int) -> None:
        self.rules.append((size, self.rank[size], items, first, each, offset))
        self.rank[size] += items
        self.left[size] -= items

    def _gap(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.sizes, gap)
            self.gaps[gap].append((first, bins))

    def _match_large(self) -> None:
        large = [s for s in self.left if 3 * s > self.capacity]
        while large:
            a = large[-1]
            k = bisect_left(large, self.capacity - a + 1) - 1  # the longest that fits beside it
            b = large[k] if k >= 0 else None
            if b == a and self.left[a] == 1:  # it needs another item, not itself
                b = large[k - 1] if k else None
            pairs = self.left[a] if b is None else self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
            first, self.bins = self.bins, self.bins + pairs
            if a == b:
                self._put(a, 2 * pairs, first, 2, 0)
            else:
                self._put(a, pairs, first, 1, 0)
                if b is not None:
                    self._put(b, pairs, first, 1, a)
            self._gap(self.capacity - a - (b or 0), first, pairs)
            large = [s for s in large if self.left[s]]

    def _fill_small(self) -> None:
        for s in [s for s in reversed(self.left) if self.left[s]]:
            while n := self.left[s]:
                k = bisect_left(self.sizes, s)
                if k == len(self.sizes):
                    each = self.capacity // s
                    bins = -(-n // each)
                    self._gap(self.capacity, self.bins, bins)
                    self.bins += bins
                    continue
                gap = self.sizes[k]
                first, bins = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap], self.sizes[k]
                each = gap // s
                full = min(bins, n // each)
                if full:
                    self._put(s, full * each, first, each, self.capacity - gap)
                    self._gap(gap - each * s, first, full)
                used = full
                if full < bins and self.left[s]:  # fewer than a bin takes are left
                    rest = self.left[s]
                    self._put(s, rest, first + full, each, self.capacity - gap)
                    self._gap(gap - rest * s, first + full, 1)
                    used += 1
                self._gap(gap, first + used, bins - used)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Rows equal in doc_id and piece (repeated documents) are packed one by one.  Empty input gives an empty result.
    """
    pieces = staged(pieces, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "_rank")
    rules = np.array(sorted(plan.rules) or [(0,) * 6], np.int64)  # a few thousand at most: steps grow with the lengths, not the rows

    def place(batches):
        key = rules[:, 0] * (1 << 48) + rules[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            rule = rules[np.searchsorted(key, size * (1 << 48) + rank, "right") - 1]
            k = rank - rule[:, 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(rule[:, 3] + k // rule[:, 4]), pa.array(rule[:, 5] + k % rule[:, 4] * size)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Documents (doc_id, text; other columns are left out) -> pieces with their sequence and offset.

    A null or empty text is one piece that holds the end id alone.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
