"""URL filters as a sort-merge range join.

A host's canonical key is its labels in reverse, each followed by a dot (www.example.com -> com.example.www.), so
"the host and all its subdomains" is the interval of keys that start with the rule's key.  Rules and urls are
sorted together by key; a sweep keeps a stack of the rules whose interval the key is in.  Intervals of keys either
nest or are apart, so a rule leaves the stack when the first key without its prefix comes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ranges, range_bounds, shuffle_partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, its A-Z lower-cased, and what follows it up to ? or #; both empty without one."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_host(host: Column) -> Column:
    """com.example.www. for www.example.com; dots become U+0001, which sorts before all that a label may hold.

    A U+0001 or U+0002 in a host has a U+0002 put before it, so none is taken for a dot.
    """
    labels = F.split(F.regexp_replace(host, "([\u0001\u0002])", "\u0002$1"), r"\.")
    return F.concat(F.array_join(F.reverse(labels), "\u0001"), F.lit("\u0001"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", per_sample: int = 40) -> DataFrame:
    """(page_id, url) and rules (host, path, verdict) -> page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest host and path
    together win, then the longer host, then the smaller verdict.  A url that no rule fits gets `default` and a null
    rule.  Null urls and urls without :// have an empty host and path, and only a rule with both empty fits those.
    Rows stay as often as they come; empty tables and tables without rules work; other columns are left out.

    Rows are dealt to ranges of (key, hash), so a host with a third of all rows spreads over many; a rule goes to
    every range that its interval touches.  The bounds come from a sample, which decides only where rows go.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host"))).withColumn("spread", F.xxhash64("page_id", "path"))
    parts = 2 * shuffle_partitions(spark)
    rows = urls.count()
    bounds = range_bounds(urls, ["key", "spread"], parts, rows, per_sample)
    at_or_before = lambda k, s: Ranges(bounds, [k, s], ["string", "bigint"]).index()
    least, most = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1)
    asked = urls.select(at_or_before(F.col("key"), F.col("spread")).alias("range"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    lows = F.coalesce(F.col("host").cast("string"), F.lit(""))
    given = rules.select(F.translate(lows, _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string")).distinct()
    given = given.withColumn("key", reversed_host(F.col("host")))
    # A key that starts with the rule's is below the rule's key followed by the largest character.
    span = F.sequence(at_or_before(F.col("key"), least), at_or_before(F.concat(F.col("key"), F.lit("\U0010ffff")), most))
    given = given.select(F.explode(span).alias("range"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")

    def sweep(batches):
        at, stack = None, []
        for batch in batches:
            out = []
            for where, key, kind, page, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "kind", "page_id", "host", "path", "verdict"))):
                if where != at:
                    at, stack = where, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    top = stack[-1]
                    if path not in top[2] or verdict < top[2][path]:
                        top[2][path] = verdict
                        if len(path) not in top[3]:
                            top[3].append(len(path))
                    continue
                best = None
                for _, rule_host, paths, sizes in stack:
                    for n in sizes:
                        if n <= len(path) and (v := paths.get(path[:n])) is not None:
                            best = max(best or (-1,), (len(rule_host) + n, len(rule_host), rule_host + path[:n], v), key=lambda x: x[:2])
                out.append((page, host, path, best and best[2], best[3] if best else default))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + 4 * [pa.string()])], names=["page_id", "host", "path", "rule", "verdict"])

    both = asked.unionByName(given).repartition(parts, "range").sortWithinPartitions("range", "key", "kind")
    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
