"""Periodic runs of words: a run is a stretch with period q that no neighbouring word extends.

Every run has, under some order of the words or under its reverse, a Lyndon word of length q as the longest one that
starts at its first whole root.  The longest Lyndon word of each place comes from the first phase of Baier's suffix
sorter: groups of suffixes, taken from the highest, lengthen the prefix shared by the groups of what stands before
them, and when a group is taken its shared prefix is that word.  No suffix array is built.  Each such root is extended
to both sides as far as words q apart are equal.

A run of at least e periods has each pair of neighbouring words at least e - 1 times, so a text is cut where a pair is
rarer than that, and the sorter runs on what is left.  A document is one row and one task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHAPE = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_lengths(keys: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, the text's end being below all keys."""
    n = len(keys)
    order = sorted(range(1, n + 1), key=lambda i: keys[i - 1])  # places from 1; 0 stands before the text
    slot, group, size, length = [0] * (n + 1), [-1] * (n + 1), [0] * n, [1] * (n + 1)
    first = 0
    for k, i in enumerate(order):
        if k and keys[i - 1] != keys[order[k - 1] - 1]:
            first = k
        slot[i], group[i] = k, first
        size[first] += 1
    lower = list(range(n + 1))  # a place's nearest one to the left, itself included, whose group has not been taken
    end = n
    while end:
        start = group[order[end - 1]]
        taken, width = order[start:end], length[order[start]]
        for i in taken:
            lower[i] = i - 1
        met: dict[int, int] = {}
        for i in taken:
            j = i - 1
            while lower[j] != j:
                lower[j] = lower[lower[j]]
                j = lower[j]
            lower[i] = j
            if j:
                met[j] = met.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in met.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for (times, old), places in sorted(moved.items()):  # those before most members of the group go highest
            new = old + size[old] - len(places)
            if new != old:
                for k, j in enumerate(places, new):
                    other, at = order[k], slot[j]
                    order[k], order[at] = j, other
                    slot[j], slot[other] = k, at
                    group[j] = new
                size[old] -= len(places)
                size[new] = len(places)
            for j in places:
                length[j] -= times * width
        end = start
    return length[1:]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common from their beginnings."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 4 * step
    return n


def _runs_within(ids: np.ndarray, first: int, least_length: int, least_exponent: float, out: set) -> None:
    n = len(ids)
    keys = np.unique(ids, return_inverse=True)[1]
    for ordered in (keys, keys.max() - keys):
        period = np.array(lyndon_lengths(ordered.tolist()), np.int64)
        place = np.arange(n)
        fits = np.maximum(least_length, least_exponent * period) <= n
        if least_exponent >= 3:  # two whole roots of such a run follow each other, both found
            follow = place[place + 2 * period <= n]
            step = period[follow]
            follow = follow[(period[follow + step] == step) & (ids[follow] == ids[follow + step]) & (ids[follow + step - 1] == ids[follow + 2 * step - 1])]
            twice = np.zeros(n, bool)
            twice[follow] = True
            fits &= twice
        at = np.flatnonzero(fits)
        last, low, high = 0, 0, 0
        for i, q in zip(*(x.tolist() for x in (at[np.lexsort((at, period[at]))], np.sort(period[at])))):
            if q == last and low <= i and i + q <= high:
                continue  # a root of the stretch just extended
            last = q
            low, high = i - _equal_ahead(ids[:i][::-1], ids[: i + q][::-1]), i + q + _equal_ahead(ids[i:], ids[i + q :])
            if high - low >= max(least_length, least_exponent * q):
                out.add((first + low, high - low, q))


def find_runs(ids: np.ndarray, least_length: int = 2, least_exponent: float = 2) -> list[tuple[int, int, int]]:
    """Word numbers -> (start, length, period) of every run of that length and exponent, by start, then period."""
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    n, out = len(ids), set()
    if n < max(2, least_length):
        return []
    pairs = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    _, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
    may = np.zeros(n + 1, bool)
    may[1:n] = times[which] >= int(least_exponent) - 1  # n - 1 pairs, closed at both ends
    edge = np.flatnonzero(may[1:] != may[:-1])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a + 1 >= least_length:
            _runs_within(ids[a : b + 1], a, least_length, least_exponent, out)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def word_runs(docs: DataFrame, least_length: int = 6, least_exponent: float = 4) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    Words are what ASCII white space leaves; `collapsed` keeps of each run its first period.  Null, empty and blank
    texts have no words, no runs and an empty collapsed text.  Rows stay as often as they come, whatever their doc_id;
    an empty table gives an empty result; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least_length, least_exponent)
                rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(words, runs).decode()))
                held += len(rows[-1][3])
                if held > 1 << 23:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SHAPE)


def digest_runs(found: DataFrame) -> DataFrame:
    """word_runs() -> doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("early"), (-r["period"]).alias("short"), r.alias("run"))))["run"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("_best", best)
    part = lambda name: F.col(f"_best.{name}")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), part("start").alias("start"), part("length").alias("length"), part("period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text: in a tenth of the documents, by a hash of doc_id, the words repeat from some place on.

    With h the CRC-32 of the decimal doc_id and g = h div 10, the rows with h divisible by 10 that have n > 0 words
    get word a + (i - a) % p in each place i >= a, for a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    plain = docs.where(F.coalesce(h % 10 != 0, F.lit(True)) | F.coalesce(~F.col("text").rlike("[^ \t-\r]"), F.lit(True)))
    chosen = docs.where((h % 10 == 0) & F.col("text").rlike("[^ \t-\r]")).withColumn("_g", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10"))
    chosen = chosen.withColumn("_w", F.split(F.regexp_replace("text", "^[ \t-\r]+|[ \t-\r]+$", ""), "[ \t-\r]+")).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.expr("cast(_g % _n AS int)")).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) AS int)"))
    cycle = F.flatten(F.array_repeat(F.expr("slice(_w, _a + 1, _p)"), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    words = F.slice(F.concat(F.expr("slice(_w, 1, _a)"), cycle), F.lit(1), F.col("_n"))
    return plain.unionByName(chosen.select("doc_id", F.array_join(words, " ").alias("text")))
