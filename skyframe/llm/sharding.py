"""Balanced label propagation: linked documents move to the shards of their neighbours under quotas.

A link column groups documents (equal texts, one host, ...); all members of a group are neighbours.  A group is
a star around its value rather than all pairs, and what a member needs to know of it is how many members each shard
holds.  Documents with the same links in the same shard are alike, so a round keeps one row for each combination of
links, with the number it has in every shard.  A round counts votes and lets all documents propose the best shard.  As
many proposals from one shard to another are admitted as come back from there, and beyond that as many as there is room
for, those that gain most first.  Every other round only shards with room may be proposed, for what finds no exchange.
Documents without links are the ballast that keeps shards even: they give way to linked ones, and only as many move
as must.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gapless_rank, hot_lookup, staged


def balanced_shards(nodes: DataFrame, links: list[str], shards: int = 24, rounds: int = 40, settled: float = 1e-4) -> DataFrame:
    """Adds shard and slot to `nodes`, whose `node` counts from 0 without gaps; shard sizes differ by one at most.

    `slot` counts from 0 without gaps within a shard.  Rounds end when two in turn move fewer than `settled` of the
    linked documents; `rounds` bounds them.  Null link values link nothing.  An empty table gives an empty result.
    """
    shards = int(shards)
    rows = nodes.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = nodes.withColumn("shard", F.pmod("node", F.lit(shards)).cast("int"))  # even from the start
    linked = F.lit(False)
    for c in links:
        sizes = nodes.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_linked", F.lit(True))
        nodes = hot_lookup(nodes, sizes, c, rows).withColumnRenamed("_linked", f"_linked_{c}")
        linked = linked | F.coalesce(f"_linked_{c}", F.lit(False))
    key = F.col(links[0]) if len(links) == 1 else F.struct(*links)
    nodes = staged(nodes.withColumn("_linked", linked).withColumn("_key", key), "nodes")
    held = nodes.where("_linked").groupBy("_key", *links, "shard").agg(F.count(F.lit(1)).alias("n"))
    state = held.groupBy("_key", *links).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
    load = _sizes(nodes.where("_linked"), shards)
    members, quiet, exchange = sum(load), 0, True
    for turn in range(rounds if members else 0):
        room = [max(0, q - n) for q, n in zip(quota, load)]
        asked = staged(_proposals(state, links, members, shards, turn, [s for s in range(shards) if room[s] or exchange]), "asked")
        flows = _asks(asked).groupBy("shard", "to", "gain").agg(F.sum("n").alias("n")).collect()  # shards^2 x gains at most
        flows = {tuple(r)[:3]: r["n"] for r in flows}
        limits = {x[:3]: x[3] for x in _admitted([(*k, n) for k, n in flows.items()], room)}
        for (f, t, _), n in limits.items():
            load[f], load[t] = load[f] - n, load[t] + n
        moved = sum(limits.values())
        state = _moved(asked, _thresholds(asked, limits, flows, members))
        if moved > settled * members:
            quiet = 0
            continue
        quiet, exchange = quiet + 1, not exchange
        if quiet == 2:
            break
    placed = _placed(nodes.where("_linked").select("node", "_key"), state, members)
    placed = gapless_rank(placed, ["shard"], ["node"], members, "slot") if members else placed.withColumn("slot", F.lit(0).cast("long"))
    ballast = nodes.where("NOT _linked").select("node", "shard")
    had = _sizes(ballast, shards)
    free = [q - n for q, n in zip(quota, load)]
    stay = [min(h, f) for h, f in zip(had, free)]
    # Those over a shard's share are numbered through, and fill the other shards' free slots in order.
    sent, got, at = [], [], 0
    for s in range(shards):
        sent.append(at)
        at += had[s] - stay[s]
    at = 0
    for s in range(shards):
        got.append(at)
        at += free[s] - stay[s]
    longs = lambda xs: F.array(*(F.lit(int(x)) for x in xs))
    own, r = F.col("shard"), F.col("_r")
    ballast = gapless_rank(ballast, ["shard"], ["node"], rows, "_r").withColumn("_move", longs(sent)[own] + r - longs(stay)[own])
    target = F.size(F.filter(longs(got), lambda g: g <= F.col("_move"))) - 1
    ballast = ballast.withColumn("_to", F.when(r >= longs(stay)[own], target).otherwise(own))
    slot = longs(load)[F.col("_to")] + F.when(r >= longs(stay)[own], longs(stay)[F.col("_to")] + F.col("_move") - longs(got)[F.col("_to")]).otherwise(r)
    placed = placed.select("node", "shard", "slot").unionByName(ballast.select("node", F.col("_to").cast("int").alias("shard"), slot.cast("long").alias("slot")))
    return nodes.drop("shard", "_linked", "_key", *(f"_linked_{c}" for c in links)).join(placed, "node")


def _proposals(state: DataFrame, links: list[str], members: int, shards: int, turn: int, allowed: list[int]) -> DataFrame:
    """state with `asks`: of each shard's n members, the allowed shard (or the own one) with most neighbours as `to`, and `gain`, the logarithm of how many more it has.

    `_a` and `_b` are the row's place in an order by hash.
    """
    voted = state
    if len(links) == 1:  # the row has all members of its group
        voted = voted.withColumn(f"_v_{links[0]}", F.col("held"))
    else:
        state = voted = cut(state)
        for c in links:
            held = state.where(F.col(c).isNotNull()).select(c, F.explode("held").alias("shard", "n"), F.lit(1).alias("_r"))
            votes = held.groupBy(c, "shard").agg(F.sum("n").alias("n"), F.sum("_r").alias("_r"))
            votes = votes.groupBy(c).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias(f"_v_{c}"), F.max("_r").alias("_n"))
            voted = hot_lookup(voted, cut(votes), c, members)
    score = lambda s: sum((F.coalesce(F.try_element_at(f"_v_{c}", s), F.lit(0)) for c in links), F.lit(0))
    # Equal scores: the first shard after the group's number for the round, the same for all of its members.
    rated = lambda s: F.struct(score(s).alias("score"), F.pmod(F.hash(*links, F.lit(turn)) - s, F.lit(shards)).alias("tie"), s.alias("shard"))
    voted = voted.withColumn("_top", F.array_max(F.transform(F.array(*map(F.lit, allowed)).cast("array<int>"), rated)))
    rows = F.transform(F.map_entries("held"), lambda e: F.struct(e["key"].alias("shard"), e["value"].alias("n"), rated(e["key"]).alias("own")))
    rows = F.transform(rows, lambda r: F.struct(r["shard"].alias("shard"), r["n"].alias("n"), r["own"]["score"].alias("own"), F.greatest(r["own"], F.col("_top")).alias("best")))
    gain = lambda r: F.floor(F.log2(r["best"]["score"] - r["own"] + F.lit(len(links)) + 1)).cast("int")
    asks = F.transform(rows, lambda r: F.struct(r["shard"].alias("shard"), r["n"].alias("n"), r["best"]["shard"].alias("to"), gain(r).alias("gain")))
    return voted.select("_key", *links, asks.alias("asks"), F.xxhash64("_key").alias("_a"), F.xxhash64("_key", F.lit(1)).alias("_b"))


def _asks(asked: DataFrame) -> DataFrame:
    return asked.select("_a", "_b", F.inline("asks")).where("to <> shard")


def _admitted(flows: list[tuple[int, int, int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(shard, to, gain, proposals) -> (shard, to, gain, how many of them are admitted).

    Exchanges, in which every shard gives as many as it takes, come first; what is left fills the room.
    """
    total: dict[tuple[int, int], int] = {}
    for f, t, _, n in flows:
        total[f, t] = total.get((f, t), 0) + n
    swaps, room, out = _exchanges(total), list(room), []
    for f, t, gain, n in sorted(flows, key=lambda x: (-x[2], x[0], x[1])):
        swapped = min(n, swaps[f, t])
        swaps[f, t] -= swapped
        filled = min(n - swapped, room[t])
        room[t] -= filled
        if swapped + filled:
            out.append((f, t, gain, swapped + filled))
    return out


def _exchanges(total: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """What of the flows between shards goes round in circles: direct exchanges, then longer circles as a walk finds them."""
    taken = {(f, t): min(n, total.get((t, f), 0)) for (f, t), n in total.items()}
    left: dict[int, dict[int, int]] = {}
    for (f, t), n in sorted(total.items()):
        if n > taken[f, t]:
            left.setdefault(f, {})[t] = n - taken[f, t]
    for start in sorted(left):
        path = [start]
        while path:
            ahead = left.get(path[-1])
            if not ahead:  # leads nowhere
                dead = path.pop()
                if path:
                    del left[path[-1]][dead]
                continue
            t = next(iter(ahead))
            if t not in path:
                path.append(t)
                continue
            circle = [*path[path.index(t) :], t]
            push = min(left[a][b] for a, b in zip(circle, circle[1:]))
            for a, b in zip(circle, circle[1:]):
                taken[a, b] += push
                left[a][b] -= push
                if not left[a][b]:
                    del left[a][b]
            path = path[: path.index(t) + 1]
    return taken


_END = (1 << 63) - 1


def _thresholds(asked: DataFrame, limits: dict[tuple, int], flows: dict[tuple, int], members: int) -> dict[tuple, tuple[int, int, int]]:
    """For each kind (shard, to, gain) with admitted proposals the place in the hash order before which all go, and how many go at that place.

    Two levels: sums by ranges of the order find the range that a limit falls into, and only its rows are ordered.
    """
    kinds = ["shard", "to", "gain"]
    out = {k: (_END, _END, 0) for k, n in limits.items() if n == flows[k]}
    partly = [(*k, n) for k, n in limits.items() if n < flows[k]]
    if not partly:
        return out
    bits = members.bit_length() // 2 + 1  # about as many ranges as rows in one
    most = F.broadcast(asked.sparkSession.createDataFrame(partly, "shard int, to int, gain int, _most long"))  # shards^2 x gains at most
    rows = _asks(asked).join(most, kinds).withColumn("_range", F.shiftright("_a", 64 - bits))
    before = lambda *order: F.sum("n").over(Window.partitionBy(*kinds).orderBy(*order)) - F.col("n")
    crosses = (F.col("_before") < F.col("_most")) & (F.col("_most") <= F.col("_before") + F.col("n"))
    ranges = rows.groupBy(*kinds, "_range", "_most").agg(F.sum("n").alias("n")).withColumn("_before", before("_range")).where(crosses)
    ranges = F.broadcast(ranges.select(*kinds, "_range", F.col("_before").alias("_start")))  # one for each kind
    rows = rows.join(ranges, [*kinds, "_range"]).withColumn("_before", F.col("_start") + before("_a", "_b")).where(crosses)
    for r in rows.select(*kinds, "_a", "_b", (F.col("_most") - F.col("_before")).alias("part")).collect():  # one for each kind
        out[r["shard"], r["to"], r["gain"]] = (r["_a"], r["_b"], r["part"])
    return out


def _moved(asked: DataFrame, thresholds: dict[tuple, tuple[int, int, int]]) -> DataFrame:
    """The state after the admitted proposals, row by row."""
    table = json.dumps({",".join(map(str, k)): dict(zip("abn", v)) for k, v in thresholds.items()})
    asked = asked.withColumn("_t", F.from_json(F.lit(table), "map<string,struct<a:long,b:long,n:long>>"))

    def going(x):
        at = F.try_element_at("_t", F.concat_ws(",", x["shard"], x["to"], x["gain"]))
        first = (F.col("_a") < at["a"]) | ((F.col("_a") == at["a"]) & (F.col("_b") < at["b"]))
        here = (F.col("_a") == at["a"]) & (F.col("_b") == at["b"])
        return F.when(first, x["n"]).when(here, F.least(at["n"], x["n"])).otherwise(F.lit(0))

    go = F.transform("asks", lambda x: F.struct(x["shard"].alias("shard"), x["n"].alias("n"), x["to"].alias("to"), F.when(x["to"] != x["shard"], going(x)).otherwise(F.lit(0)).alias("go")))
    parts = F.concat(F.transform("_go", lambda x: F.struct(x["shard"].alias("shard"), (x["n"] - x["go"]).alias("n"))), F.transform("_go", lambda x: F.struct(x["to"].alias("shard"), x["go"].alias("n"))))
    asked = asked.withColumn("_go", go).withColumn("_parts", F.filter(parts, lambda x: x["n"] > 0))
    of = lambda s: F.aggregate(F.filter("_parts", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    held = F.transform(F.array_distinct(F.transform("_parts", lambda x: x["shard"])), lambda s: F.struct(s.alias("shard"), of(s).alias("n")))
    return asked.withColumn("held", F.map_from_entries(held)).drop("asks", "_a", "_b", "_t", "_go", "_parts")


def _placed(nodes: DataFrame, state: DataFrame, members: int) -> DataFrame:
    """(node, shard): the members of a row of the state, in the order of their numbers, fill its shards one after another."""
    held = F.array_sort(F.map_entries("held"))
    ends = F.transform(F.sequence(F.lit(1), F.size("_h")), lambda k: F.aggregate(F.slice("_h", 1, k), F.lit(0).cast("long"), lambda n, x: n + x["value"]))
    total = F.aggregate("_h", F.lit(0).cast("long"), lambda n, x: n + x["value"])
    rows = state.select("_key", held.alias("_h")).select("_key", F.transform("_h", lambda x: x["key"]).alias("_shards"), ends.alias("_ends"), total.alias("_n"))
    ranked = hot_lookup(gapless_rank(nodes, ["_key"], ["node"], members, "_r"), rows, "_key", members)
    return ranked.select("node", F.try_element_at("_shards", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))) + 1).alias("shard"))


def cut_share(placed: DataFrame, link: str) -> float:
    """The share of linked rows that are not in the shard with most of their group: what propagation is to make small."""
    here = placed.where(F.col(link).isNotNull()).groupBy(link, "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = here.groupBy(link).agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("n > 1")
    n, top = groups.agg(F.sum("n"), F.sum("top")).first()
    return 1 - top / n if n else 0.0



def _sizes(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; equal texts are linked.

    The law is `rows`: shards hold equally many documents, or one more.  A null text has no bytes and is linked with
    empty ones.  Repeated rows are documents of their own; null doc_ids are numbered like others.  Other columns are
    left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("same"))
    facts = staged(facts, "facts")
    nodes = cut(gapless_rank(facts, [], ["doc_id", "same"], facts.count(), "node"))
    out = balanced_shards(nodes, ["same"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
