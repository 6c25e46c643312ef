"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item is cut into windows of so many consecutive words; an item of fewer words is one window.  A window is a set of
shingles, each with its place in it.  Shingles are ordered by rarity in the documents, and if at least t of a window's
s shingles must be found, one of its s - t + 1 rarest ones must: its prefix.  Only those are joined.

1. One pass over the documents counts the shingles that items have (a bitmap lets the others go by).
2. Each window picks its prefix by those counts.
3. A second pass finds prefix shingles, with the words around them; a join on the shingle pairs them with windows.
4. A pair goes where the shingle's place in the window would put the window beyond the document's ends, or where the
   window has more words than the document; the rest are compared word by word over the window's size.

Bitmaps are of 8 MB whatever the number of windows; where they let too much pass, the joins do the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, staged

FILTER_BITS = 26
#: A-Z to lower case; all other ASCII characters but digits and a-z to a space
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """XXH64 of words; the ones met are kept, up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for each `size` consecutive words."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : k + n]
    return out ^ (out >> np.uint64(32))


def _text_words(column: pa.Array, hashes: _Hashes):
    """(words, their hashes) of each text; a null one has none."""
    for value in column:
        words = words_of(value.as_buffer().to_pybytes()) if value.is_valid else []
        yield words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, text) -> item_id, item (a digest of its words), win: each window's words joined by spaces, once an item."""

    def run(batches):
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                size = min(window, len(words))
                wins = dict.fromkeys(b" ".join(words[i : i + size]).decode() for i in range(len(words) - size + 1)) if words else {}
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(wins), pa.string()), pa.array([digest] * len(wins), pa.binary()), pa.array(list(wins), pa.string())], names=["item_id", "item", "win"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, item binary, win string")


def window_shingles(wins: DataFrame, shingle: int) -> DataFrame:
    """win -> win, n_words, size (words of a shingle: fewer where the window has fewer), place, hash."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for win, (words, own) in zip(batch.column(0), _text_words(batch.column(0), hashes)):
                size = min(shingle, len(words))
                found = _signed(shingle_hashes(own, size))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([win.as_py()] * n, pa.string()), pa.array([len(words)] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(found)],
                    names=["win", "n_words", "size", "place", "hash"],
                )

    return wins.select("win").mapInArrow(run, "win string, n_words int, size int, place int, hash long")


def _bitmap(hashes: DataFrame):
    """A broadcast bitmap of hashed shingles: at most 2^FILTER_BITS bits, made of 32,768-bit pieces."""
    place = F.pmod("hash", F.lit(1 << FILTER_BITS))
    pieces = hashes.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in pieces:
        at = r["piece"] << 12
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _passing(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the shingles whose bit is set."""
    place = found & np.uint64((1 << FILTER_BITS) - 1)
    return np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def shingle_counts(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """(hash, count): how often the documents have each shingle that items have (and a few others)."""
    filter_bits = _bitmap(hashes)

    def run(batches):
        memo, bits = _Hashes(), filter_bits.value
        for batch in batches:
            held, n = [], 0
            for _, own in _text_words(batch.column(0), memo):
                for size in sizes:
                    found = shingle_hashes(own, size)
                    held.append(found[_passing(found, bits)])
                    n += len(held[-1])
                if n > 1 << 20:
                    held, n = [np.concatenate(held)], 0
                    yield counted(held[0])
                    held = []
            yield counted(np.concatenate(held) if held else np.zeros(0, np.uint64))

    def counted(found):
        values, times = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(times.astype(np.int64))], names=["hash", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("count"))


def prefixes(shingles: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The rarest shingles of each window that the documents have: win, n_words, size, place, hash.

    All s - ceil(least * s) + 1 rarest are needed; those that no document has can be left out.
    """
    rows = shingles.count()
    known = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).join(counts, "hash")
    ranked = hot_lookup(shingles, known, "hash", rows)
    ranked = ranked.groupBy("win", "n_words", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "hash"))).alias("all"))
    needed = F.size("all") - F.ceil(F.lit(least) * F.size("all") - 1e-9).cast("int") + 1
    ranked = ranked.select("win", "n_words", "size", F.explode(F.slice("all", F.lit(1), needed)).alias("p"))
    return ranked.where("p.count > 0").select("win", "n_words", "size", "p.place", "p.hash")


def candidates(docs: DataFrame, hashes: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """Each document with its prefix shingles: row, doc_id, n_words, found (hash, pos, before, context).

    `context` are the words from `before` words ahead of the shingle to the end of any window that holds it, as far as
    the document goes.  `row` is a number that no other row has.
    """
    filter_bits = _bitmap(hashes)
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))

    def run(batches):
        memo, bits = _Hashes(), filter_bits.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, held = [], 0
            for doc_id, (words, own) in zip(batch.column(0).to_pylist(), _text_words(batch.column(1), memo)):
                some = []
                for size in sizes:
                    found = shingle_hashes(own, size)
                    at = _passing(found, bits)
                    for pos, value in zip(at.tolist(), _signed(found[at]).tolist()):
                        before = min(pos, window - size)
                        context = b" ".join(words[pos - before : pos + window]).decode()
                        some.append({"hash": value, "pos": pos, "before": before, "context": context})
                        held += len(context)
                out.append((number, doc_id, len(words), some))
                number += 1
                if held > 1 << 22:
                    yield packed(out)
                    out, held = [], 0
            yield packed(out)

    def packed(out):
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), kind])], names=["row", "doc_id", "n_words", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, found array<struct<hash:long,pos:long,before:int,context:string>>")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of a found shingle and a window whose words agree: row, start, n_words, win."""
    start = F.col("pos") - F.col("place")
    pairs = pairs.where((start >= 0) & (start + F.col("n_words") <= F.col("doc_words")))
    pairs = pairs.withColumn("start", start).withColumn("_theirs", F.slice(F.split("context", " "), F.col("before") - F.col("place") + 1, F.col("n_words")))
    if least >= 1:
        agree = F.array_join("_theirs", " ") == F.col("win")
    else:  # as many of the window's shingles, each in its place, as are asked for
        same = F.zip_with("_theirs", F.split("win", " "), lambda a, b: a == b)
        whole = F.transform(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1), lambda i: F.forall(F.slice(same, i, F.col("size")), lambda x: x).cast("int"))
        total = F.aggregate(whole, F.lit(0), lambda a, b: a + b)
        agree = total >= F.ceil(F.lit(least) * F.size(whole) - 1e-9)
    return pairs.where(agree).select("row", "start", "n_words", "win")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, least: float = 1.0) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, n_words, n_hit, item_ids, contaminated.

    Words are runs of ASCII letters (lower-cased), digits and all that is not ASCII.  A document word is hit if any
    occurrence of an item's window holds it; item_ids are those items, different ones, sorted as strings.  An
    occurrence has the window's words one after another or, with `least` under 1, that share of its shingles in their
    places.  Null, empty and wordless texts have no words and no windows; an item without an id marks words but is no
    item of the list; items that share an id are one.  Rows stay as often as they come; empty tables work; other
    columns are left out.
    """
    windows = staged(item_windows(items, window), "item-windows")
    shingles = staged(window_shingles(windows.select("win").distinct(), shingle), "item-shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most `shingle` of them
    counts = staged(shingle_counts(docs, shingles, sizes), "shingle-counts")  # looked up several times
    chosen = staged(prefixes(shingles, counts, least), "prefixes")
    rows = staged(candidates(docs, chosen, sizes, window), "candidates")
    found = rows.select("row", F.col("n_words").alias("doc_words"), F.explode("found").alias("f")).select("row", "doc_words", "f.*")
    owners = windows.groupBy("win").agg(F.collect_set("item").alias("items"))
    asked = chosen.groupBy("hash").agg(F.collect_list(F.struct("win", F.col("n_words").alias("n_words"), "size", "place")).alias("_wins"))
    asked = found.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).join(asked, "hash")
    pairs = hot_lookup(found, asked, "hash", found.count()).select("row", "doc_words", "pos", "before", "context", F.explode("_wins").alias("w"))
    hits = staged(_verified(pairs.select("*", "w.*"), least).distinct(), "hits")
    about = hits.groupBy("win").agg(F.count(F.lit(1)).alias("_n")).join(owners, "win")
    hits = hot_lookup(hits, about, "win", hits.count())
    hits = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))["n"]
    hits = staged(hits.select("row", covered.alias("n_hit"), "items"), "hit-rows")
    members = windows.where("item_id IS NOT NULL").groupBy("item").agg(F.collect_set("item_id").alias("ids"))
    listed = hits.select("row", F.explode("items").alias("item"))
    known = listed.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).join(members, "item")
    ids = hot_lookup(listed, known, "item", listed.count()).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    out = rows.select("row", "doc_id", "n_words").join(hits.drop("items"), "row", "left").join(ids, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))
