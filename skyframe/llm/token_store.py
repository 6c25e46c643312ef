"""Token ids as binary shards with Elias-Fano document boundaries.

A shard is one record of a Parquet table (so that Spark commits it, retries it and can keep it in any store):
`doc_ids` and a `blob` of this format, all numbers little-endian:

    8 bytes   magic "EFIDS1" and two zero bytes
    B B H     bytes an id (2 or 4), low bits a boundary, zero
    I I Q     documents, bytes of the high bits, ids
    ...       low bits, packed; high bits in unary; one 32-bit position for every 64th set high bit; ids

The boundaries are the ends of the documents, in ids.  They take about 2 + log2(ids / documents) bits each and
half a bit for select; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, range_bounds, shuffle_partitions
from .tokens import encoded, encoder, give_back

MAGIC, HEAD, EVERY = b"EFIDS1\0\0", struct.Struct("<8sBBHIIQ"), 64


class EliasFano:
    """A non-decreasing sequence of numbers below or equal to `universe`."""

    def __init__(self, low: np.ndarray, bits: int, high: bytes, marks: np.ndarray, n: int):
        self.low, self.bits, self.high, self.marks, self.n = low, bits, high, marks, n

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((universe >> bits) + n + 1, np.uint8)
        unary[ones] = 1
        return cls(low, bits, np.packbits(unary, bitorder="little").tobytes(), ones[::EVERY].astype("<u4"), n)

    def select(self, i: int) -> int:
        """The i-th value, from one directory entry and the bytes after it."""
        at, left = int(self.marks[i // EVERY]), i % EVERY
        byte, skip = divmod(at, 8)
        word = self.high[byte] >> skip << skip
        while left >= (ones := word.bit_count()):
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = 8 * byte + (word & -word).bit_length() - 1 - i
        start = i * self.bits
        value = int.from_bytes(self.low[start // 8 : (start + self.bits + 7) // 8].tobytes(), "little") >> start % 8
        return high << self.bits | value & (1 << self.bits) - 1

    def values(self) -> np.ndarray:
        """All of them at once."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
        return (high << self.bits) + (low.astype(np.int64) << np.arange(self.bits)).sum(1)


def pack_shard(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    ef = EliasFano.of(ends, len(ids))
    head = HEAD.pack(MAGIC, width, ef.bits, 0, len(ends), len(ef.high), len(ids))
    return b"".join((head, ef.low.tobytes(), ef.high, ef.marks.tobytes(), ids.astype(f"<u{width}").tobytes()))


def open_shard(blob: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries, and the ids without copying them."""
    magic, width, bits, _, docs, high, n = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    low = np.frombuffer(blob, np.uint8, (docs * bits + 7) // 8, at)
    at += len(low)
    marks_at = at + high
    marks = np.frombuffer(blob, "<u4", -(-docs // EVERY), marks_at)
    return EliasFano(low, bits, blob[at:marks_at], marks, docs), np.frombuffer(blob, f"<u{width}", n, marks_at + 4 * len(marks))


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 1 << 21, shard_docs: int = 1 << 16) -> None:
    """Writes the ids of (doc_id, text) in ascending doc_id order; a null text is empty, a null doc_id comes first.

    Equal doc_ids stand together, in the order of a hash of their texts.  Other columns are left out.  An empty table
    gives a table without shards.  A shard is cut after `shard_ids` ids, so only a longer document makes a larger one.

    Texts are tokenised where they are read; packed ids are what is shuffled, to ranges of doc_id and hash.
    """
    spark = docs.sparkSession
    order = ["_set", "_id", "_mix"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().cast("long").alias("_set"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text").alias("_mix"), "text")
    parts = shuffle_partitions(spark)
    bounds = range_bounds(rows, order, parts, rows.count(), per_range=200)
    rows = rows.withColumn("_range", Ranges(bounds, [F.col(c) for c in order], ["bigint"] * 3).index())
    kept = ["_range", *order]

    def width() -> int:
        return 2 if encoder(tokenizer).n_ids <= 1 << 16 and end_id < 1 << 16 else 4

    def tokenised(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            done = 0
            ids, size = [], 0
            for i, one in encoded(tokenizer, batch.column("text"), 1 << 20):
                ids.append(np.frombuffer(one + end, "<u4").astype(f"<u{width()}").tobytes())
                size += len(ids[-1])
                if size > 1 << 21 or i + 1 == batch.num_rows:
                    some = batch.slice(done, len(ids))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])
                    done, ids, size = i + 1, [], 0
                    some = None
            batch = None
        give_back()

    def shards(batches):
        wide = width()
        part = base = k = size = 0
        ids: list[bytes] = []
        ends: list[int] = []
        names: list = []

        def shard():
            flat = np.frombuffer(b"".join(ids), f"<u{wide}")
            blob = pack_shard(flat, np.array(ends, np.int64), wide)
            cols = [pa.array([part]), pa.array([k]), pa.array([base]), pa.array([len(flat)]), pa.array([list(names)], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "shard", "base", "n_ids", "doc_ids", "blob"])

        for batch in batches:
            for where, known, name, one in zip(*(batch.column(c).to_pylist() for c in ("_range", "_set", "_id", "ids"))):
                if ends and (where != part or size >= shard_ids or len(ends) >= shard_docs):
                    yield shard()
                    base, k, size = base + size, k + 1, 0
                    ids.clear(), ends.clear(), names.clear()
                if where != part:
                    part, base, k = where, 0, 0
                ids.append(one)
                size += len(one) // wide
                ends.append(size)
                names.append(name if known else None)
            batch = None
        if ends:
            yield shard()
        ids.clear()
        give_back()

    packed = rows.mapInArrow(tokenised, "_range int, _set long, _id long, _mix long, ids binary")
    dealt = packed.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions("_range", *order, "ids")
    dealt.mapInArrow(shards, "part long, shard long, base long, n_ids long, doc_ids array<long>, blob binary").write.parquet(path)


def _part_starts(shards: DataFrame) -> dict[int, int]:
    """The ids before each part: one number for each write task."""
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    return before


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the written shards.

    `start` counts the ids of all documents before it: those of earlier parts, of earlier shards of the part, and of
    the shard, where select gives the document's bounds.
    """
    shards = spark.read.parquet(path)
    before = _part_starts(shards)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, base = batch.column("part")[row].as_py(), batch.column("base")[row].as_py()
                bounds, ids = open_shard(batch.column("blob")[row].as_py())
                ends = np.fromiter(map(bounds.select, range(bounds.n)), np.int64, bounds.n)
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [batch.column("doc_ids")[row].values, pa.array(starts + base + before[part]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "base", "doc_ids", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id) -> doc_id, ids (array): the stored ids of some documents; those that are not stored are left out.

    Their places come from the shards' doc_ids; of a shard only the wanted documents are unpacked, by select.
    """
    shards = spark.read.parquet(path)
    places = shards.select("part", "shard", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id")
    places = places.groupBy("part", "shard").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most a shard's documents

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bounds, ids = open_shard(batch.column("blob")[row].as_py())
                at = batch.column("places")[row].as_py()
                names = batch.column("doc_ids")[row].values.take(pa.array(at))
                found = [ids[bounds.select(i - 1) if i else 0 : bounds.select(i)].astype(np.int64) for i in at]
                yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.join(places, ["part", "shard"]).select("doc_ids", "places", "blob").mapInArrow(run, "doc_id long, ids array<long>")
