"""Canonical exact digests, with DataFrame and SQL functions only.

A text's canonical form is its NFKC normalisation with full case folding (ß is ss, a final sigma a sigma), every run
of white space one space, none at the ends.  Its digest is 128 bits of XXH64 under two seeds.  Texts of one bucket
(equal digest) are told apart by their bytes: the canonical forms of every bucket with more than one row, own or
edited, are grouped by digest and text, and where a bucket holds several, all but the first in order of their SHA-256
get a number added to the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Ranges, cut, range_bounds, shuffle_partitions, staged

ORDER = ["_set", "_id", "_mix"]  # whether there is a doc_id, the doc_id, a hash of the text
FILTER_BITS = 26


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)  # such a text is its own NFKC, and folds to lower case
    plain = F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " ")
    return F.trim(F.when(ascii_only, plain).otherwise(F.regexp_replace(nfkc(fold(nfkc(fold(nfkc(text))))), r"(?U)\s{2,}|[^\S ]", " ")))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    """XXH64 of the bytes under the usual seed, and under the one that a leading literal makes."""
    return F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)


def hex_digits(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def bucket_classes(forms: DataFrame) -> DataFrame:
    """(h1, h2, canon) -> h1, h2, sha, place: the forms of each bucket that has several, told apart by their bytes.

    Copies are counted where they are read, so a form with many costs no more than others.  `place` counts from 0.
    """
    classes = forms.groupBy("h1", "h2", "canon").agg(F.count(F.lit(1)).alias("copies"))
    several = classes.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.sha2("canon", 256))).alias("shas"), F.sum("copies").alias("copies")).where(F.size("shas") > 1)
    return several.select("h1", "h2", F.posexplode("shas").alias("place", "sha"))


def with_next(docs: DataFrame, made: dict[str, Column], carried: list[str]) -> DataFrame:
    """Adds the columns `made`, and next_<column> for each one carried: the next row's in ascending doc_id, after the last the first's.

    Null doc_ids come first; rows with equal doc_ids follow in the order of a hash of their texts.  Rows are dealt to
    ranges of doc_id and hash whose bounds occur; the first row of a range also goes, as a mark, to the range before
    it, so each range finds its last row's successor without a global sort.
    """
    columns = [*docs.columns, *made]
    docs = docs.withColumns({"_set": F.col("doc_id").isNotNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_mix": F.xxhash64("text")})
    n, least = docs.agg(F.count(F.lit(1)), F.min(F.struct(*ORDER))).first()
    ranges = max(1, min(n // 64, max(8 * shuffle_partitions(docs.sparkSession), n // 4096), 20_000))
    bounds = range_bounds(docs, ORDER, ranges, n)
    dealt = Ranges(bounds, [F.col(c) for c in ORDER], ["bigint"] * 3)
    first = F.lit(bool(n))
    for c, v in zip(ORDER, least or ()):
        first = first & (F.col(c) == v)
    marks = F.array(
        F.struct(F.col("_own").alias("range"), F.lit(0).alias("mark")),
        F.when(dealt.starts(F.col("_own")), F.struct((F.col("_own") - 1).alias("range"), F.lit(1).alias("mark"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("mark"))),
    )
    rows = docs.withColumn("_own", dealt.index()).withColumn("_to", F.explode(F.array_compact(marks)))
    rows = rows.select("*", F.col("_to.range").alias("_range"), F.col("_to.mark").alias("_mark")).drop("_own", "_to")
    rows = rows.repartition("_range").withColumns(made)  # made where the rows are sorted, not carried there
    order = Window.partitionBy("_range").orderBy("_mark", *ORDER, "text")
    rows = rows.select(*columns, "_mark", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return rows.where("_mark = 0").drop("_mark")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _only(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among `keys`: by a bitmap of 2^26 hashed keys (8 MB, broadcast), so texts that are not asked for stay where they are.

    Where keys are very many, the bitmap lets all rows pass; joins on the key follow.
    """
    place = F.pmod(F.col(key), F.lit(1 << FILTER_BITS))
    map_no, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    bitmap = keys.groupBy(map_no.alias("_map")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(shiftright(_bit, 3) as int) + 1, 1)")), 16, 10).cast("int")
    hit = docs.withColumns({"_map": map_no, "_bit": bit}).join(F.broadcast(bitmap), "_map").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit & 7 as int))")) != 0)
    return hit.drop("_map", "_bit", "_bits")


def _forms(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(h1, h2, canon) of all rows, own and edited, whose bucket holds more than one row; their texts are read again."""
    both = rows.select(F.col("o1").alias("h1"), F.col("o2").alias("h2")).unionAll(rows.select(F.col("n1").alias("h1"), F.col("n2").alias("h2")))
    multi = cut(both.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    in_multi = lambda a, b: rows.join(multi.select(F.col("h1").alias(a), F.col("h2").alias(b)), [a, b], "left_semi")
    own = cut(in_multi("o1", "o2").select("key").distinct())
    edits = cut(in_multi("n1", "n2").select("key", "next_key").distinct())
    wanted = own.unionAll(edits.select("key")).unionAll(edits.select(F.col("next_key").alias("key"))).distinct()
    texts = _only(docs.withColumn("key", row_key()), "key", wanted).join(wanted, "key", "left_semi").dropDuplicates(["key"]).select("key", "text")
    ahead = texts.select(F.col("key").alias("next_key"), F.col("text").alias("following"))
    canon = texts.join(own, "key", "left_semi").select(canonical(F.col("text")).alias("canon"))
    canon = canon.unionAll(edits.join(texts, "key").join(ahead, "next_key").select(canonical(edited(F.col("text"), F.col("following"))).alias("canon")))
    h1, h2 = wide_hash(F.col("canon"))
    return canon.select(h1.alias("h1"), h2.alias("h2"), "canon")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty.  The edited text is the text with its last half replaced by the next row's beginning.
    Digests are exact, so a likeness is 1 for canonical forms of equal bytes and else 0.  Rows stay as often as they
    come; an empty table gives an empty result; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, {"canon": canonical(F.col("text")), "key": row_key()}, ["text", "canon", "key"])
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text"))).withColumn("new", canonical(F.col("edit")))
    (o1, o2), (n1, n2) = wide_hash(F.col("canon")), wide_hash(F.col("new"))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "key", "next_key",
        o1.alias("o1"), o2.alias("o2"), F.unhex(F.sha2("canon", 256)).alias("o_sha"), n1.alias("n1"), n2.alias("n2"), F.unhex(F.sha2("new", 256)).alias("n_sha"),
        (F.col("canon") == F.col("new")).cast("double").alias("near_edited"), (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    )
    rows = staged(rows, "digests")
    placed = cut(bucket_classes(_forms(docs, rows)).withColumn("sha", F.unhex("sha")))  # a handful by chance, or what an attacker of XXH64 made
    several = not placed.isEmpty()  # else no row needs to meet them
    for x, name in (("o", "fingerprint"), ("n", "edited_fingerprint")):
        digits = hex_digits(F.col(f"{x}1"), F.col(f"{x}2"))
        if several:
            p = placed.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("sha").alias(f"{x}_sha"), F.col("place").alias("_p"))
            rows = rows.join(p, [f"{x}1", f"{x}2", f"{x}_sha"], "left")
            digits = F.concat(digits, F.when(F.col("_p") > 0, F.concat(F.lit("-"), F.col("_p").cast("string"))).otherwise(""))
        rows = rows.withColumn(name, digits).drop("_p")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
