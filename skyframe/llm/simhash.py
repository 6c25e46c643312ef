"""SimHash fingerprints and near-duplicate groups by Golay-code fuzzy hashing.

The perfect Golay code [23, 12, 7] maps every 23-bit word to the one codeword within 3 bits.  A word's nearby
indices are the nearest codeword's and, if that is 3 bits away, those of the five codewords 4 bits away: any two
words at most 2 bits apart share one, and the nearest codeword of a word is among the indices of every word 1 bit
apart.  A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Of at most 4 different bits, two
segments together have at most 2: either one of them is equal (its nearest index is equal, and the other's index
sets share one), or both differ in 1 bit (then the one's nearest index of the first segment and the other's of the
second is a key of both).  So the keys of a pair of segments are: nearby indices of the first with the nearest of
the second, and the reverse; at most 11, and 33 for the three pairs.  Rows that share a key are verified.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, hot_lookup

GENERATOR = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = (0, 22), (22, 21), (43, 21)  # first bit, bits
FAR = 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The majority bits of the XXH64 (seed 42) of all shingles; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]])
    ends = ends[shingle - 1 :] - 1
    digest, of = xxhash.xxh64_intdigest, joined.__getitem__
    h = np.array([digest(of(slice(a, b)), 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fp: the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << (bit - 11), words)
    return words


@cache
def near_errors() -> np.ndarray:
    """For each syndrome up to six error patterns: the nearest codeword's, then those of weight 4 if it has 3; -1: none."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for w in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), w)], np.int64)
        for s, p in zip(syndrome(patterns).tolist(), patterns.tolist()):
            if w < 4 or weight[s] == 3:
                table[s, used[s]] = p
                used[s] += 1
            if w < 4:
                weight[s] = w
    return table


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) for every key of each fingerprint."""
    near = []
    for first, bits in SEGMENTS:
        word = (fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        errors = near_errors()[syndrome(word)]
        near.append(np.where(errors < 0, -1, (word[:, None] ^ errors) >> 11))
    at, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        for a, b in [(near[i][:, k], near[j][:, 0]) for k in range(6)] + [(near[i][:, 0], near[j][:, k]) for k in range(1, 6)]:
            ok = np.flatnonzero((a >= 0) & (b >= 0))
            at.append(ok)
            keys.append(pair << 24 | a[ok] << 12 | b[ok])
    return np.concatenate(at), np.concatenate(keys)


def _links(fp: np.ndarray, start: np.ndarray, size: np.ndarray, small: int = 12):
    """Positions (i, j) that connect, within each run of rows that share a key, what links of at most FAR bits connect."""
    run = np.repeat(np.arange(len(size)), size)
    out_i, out_j = [], []
    little = np.repeat(size <= small, size)
    for d in range(1, small):
        i = np.flatnonzero((run[d:] == run[:-d]) & little[d:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= FAR]
        out_i.append(i)
        out_j.append(i + d)
    for k in np.flatnonzero(size > small).tolist():
        left = np.arange(start[k], start[k] + size[k])
        while len(left):  # a search over what has not been reached yet: a dense run is used up by a few passes
            found, left, at = [left[0]], left[1:], 0
            while at < len(found) and len(left):
                close = np.bitwise_count(fp[left] ^ fp[found[at]]) <= FAR
                if close.any():
                    found += left[close].tolist()
                    left = left[~close]
                at += 1
            found = np.array(found)
            out_i.append(found[1:])
            out_j.append(found[(np.arange(1, len(found)) - 1) // 2])  # a tree without a hub
    return np.concatenate(out_i), np.concatenate(out_j)


def near_links(points: DataFrame, most: int = 200_000) -> DataFrame:
    """Different fingerprints (fp, id) -> (a, b): ids whose connection is that of all links of at most 4 bits.

    Sorted by key, each task walks its runs.  A run of over `most` fingerprints is cut into blocks, every two of
    which meet in a run of their own, so that no task holds more than two blocks.
    """
    spark = points.sparkSession

    def keyed(batches):
        for batch in batches:
            at, key = golay_keys(batch.column("fp").to_numpy().view(np.uint64))
            cols = [pa.array(key), *(batch.column(c).take(pa.array(at)) for c in ("fp", "id"))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "id"])

    rows = points.select("fp", "id").mapInArrow(keyed, "key long, fp long, id long").withColumn("sub", F.lit(0).cast("long"))
    crowded = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)) if points.count() > most else None
    if crowded is not None and crowded.limit(1).count():
        blocks = F.ceil(F.col("n") / (most // 2)).cast("int")
        big = rows.drop("sub").join(crowded, "key").withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
        big = big.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        big = big.select("key", "fp", "id", (F.least("own", "other") * (1 << 20) + F.greatest("own", "other") + 1).alias("sub"))
        rows = rows.join(crowded, "key", "left_anti").select("key", "fp", "id", "sub").unionByName(big)

    def verified(batches):
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            key, sub = now["key"].to_numpy(), now["sub"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])) if len(key) else np.array([], int)
            if len(new) > 1:
                yield edges(now.slice(0, new[-1]), new[:-1], np.diff(new))
            kept = now.slice(new[-1]) if len(new) else kept
        if kept is not None and len(kept):
            yield edges(kept, np.array([0]), np.array([len(kept)]))

    def edges(now, start, size):
        fp, name = now["fp"].to_numpy().view(np.uint64), now["id"].to_numpy()
        i, j = _links(fp, start, size)
        pairs = np.unique(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "sub").sortWithinPartitions("key", "sub")
    return rows.mapInArrow(verified, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links.

    Fingerprints link at 4 or fewer different bits; null, empty and word-free texts have fingerprint zero and link
    like any other.  Repeated rows stay repeated; a null doc_id is never the smallest, and a component without any
    other has a null component_id.  An empty table gives an empty result; other columns are left out.
    """
    fps = cut(fingerprints(docs))
    rows = fps.count()
    # A fingerprint's id is the smallest doc_id that has it, or a number past all of them.
    past = F.lit(1 << 62) + F.xxhash64("fp").bitwiseAND(F.lit((1 << 61) - 1))
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")).select("fp", "_n", F.coalesce("least", past).alias("id")))
    groups = connected(near_links(points)).withColumnRenamed("id", "member")
    found = points.join(groups, points.id == groups.member, "left").select("fp", "_n", F.coalesce("component", "id").alias("component_id"))
    out = hot_lookup(fps, found, "fp", rows)
    least = F.when(F.col("component_id") < F.lit(1 << 62), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), least.alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each group, with the columns of `docs`.

    Of rows that repeat that doc_id one stays; rows with a null doc_id stay, as nothing tells them apart.
    """
    found = cut(near_duplicates(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    first = found.select("doc_id")
    kept = docs.join(first, docs.doc_id.cast("long") == first.doc_id, "left_semi")
    if found.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(docs.doc_id.isNull()))
