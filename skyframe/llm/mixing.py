"""Soft-membership mixing to target weights, with DataFrame functions only.

A classifier learnt from a labelled table gives every document its posteriors over domains.  Document i has t_i
tokens and a rate r_i >= 0, the expected number of times it is used; domain d then has sum_i r_i t_i p_id expected
tokens.  The rates minimise the squared distances of those totals from the targets, each over the domain's tokens at
rate 1, by projected gradient steps from rate 1.  A step needs one number for each domain from the whole corpus, and
a document's rate is a fold over those numbers, so no state of the size of the corpus is kept between steps.  Where
plain steps would go on for thousands of passes, steps scaled by the curvature (one number for each two domains) go to
the same end: rates max(0, 1 - p_i y) with the least pull to rate 1, for every domain, those with target 0 included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass
class Mixture:
    """domains, their names in order; history: the gradient's numbers for each step, one list a step; totals: wanted, reached."""

    domains: list[str]
    history: list[list[float]]
    step: float
    aim: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    def rate(self, p: Column, start: Column | None = None, after: int = 0) -> Column:
        """The rate of a document with posteriors p (an array in the order of the domains), or from its rate after so many steps."""
        start, history = start if start is not None else F.lit(1.0), self.history[after:]
        if not history:
            return start
        grads = F.array(*(F.array(*(F.lit(float(g)) for g in row)) for row in history))
        inner = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        return F.aggregate(grads, start, lambda r, g: F.greatest(F.lit(0.0), r - F.lit(self.step) * inner(g)))


def surface(docs: DataFrame) -> DataFrame:
    """Adds _words (lower-cased, cut at white space and ASCII punctuation), tokens (their number) and four shape columns.

    Shape: shares of ASCII capitals and of other marks, share of different words, logarithm of the words.

    A null text is an empty one, with no tokens.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.lower(text), r"[\s\p{Punct}]+"), "")
    n = F.greatest(F.char_length(text), F.lit(1))
    bare = F.regexp_replace(text, r"[a-z\s.,\u0080-\uffff]+", "")
    docs = docs.withColumn("_words", words).withColumn("tokens", F.size("_words").cast("long"))
    capitals = F.char_length(F.regexp_replace(bare, "[^A-Z]+", "")) / n
    kinds = F.size(F.array_distinct("_words")) / F.greatest(F.col("tokens"), F.lit(1))
    return docs.withColumns({"_a": capitals, "_b": F.char_length(bare) / n - capitals, "_c": kinds, "_d": F.log1p("tokens") / 10})


def fit_domains(docs: DataFrame, labels: DataFrame, most: int = 20_000, buckets: int = 1 << 15) -> tuple[PipelineModel, list[str]] | None:
    """Learns a document's domain from `labels` (doc_id, domain).

    About `most` labelled rows are learnt from (drawn by a hash of doc_id; never over twice as many, which is why they
    can be broadcast); a doc_id with several labels counts with its smallest domain.  None if nothing is labelled.
    """
    labels = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    n = labels.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("domain")), F.lit(1 << 30)) < F.lit(int(min(1.0, most / n) * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels.where(draw).limit(2 * most)), "doc_id")
    domains = sorted(r["domain"] for r in labels.select("domain").distinct().collect())
    rows = surface(rows).withColumn("_label", F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1)
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets, binary=True),
        VectorAssembler(inputCols=["_a", "_b", "_c", "_d", "_tf"], outputCol="_x"),
    ]
    made = staged(Pipeline(stages=stages).fit(rows).transform(rows).select("_x", "_label"), "labelled").coalesce(6)  # a bounded sample
    if made.select("_label").distinct().count() < 2:
        return None
    learn = LogisticRegression(featuresCol="_x", labelCol="_label", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_z", family="multinomial", regParam=1e-4, standardization=False, maxIter=60)
    return PipelineModel([*stages, learn.fit(made)]), domains


def posteriors(docs: DataFrame, fitted: tuple[PipelineModel, list[str]] | None) -> DataFrame:
    """Adds tokens and p, the posteriors in the order of the domains (without a model: all in one domain)."""
    rows = surface(docs)
    if fitted is None:
        return rows.withColumn("p", F.array(F.lit(1.0))).drop("_words", "_a", "_b", "_c", "_d")
    rows = fitted[0].transform(rows).withColumn("p", vector_to_array("_p"))
    return rows.drop("_words", "_a", "_b", "_c", "_d", "_tf", "_x", "_p", "_y", "_z")


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], scale: float | None = None, steps: int = 2, close: float = 1e-4, exact: int = 80, headroom: float | None = None, zero_pull: float = 1e-4, keep_every: int = 8) -> Mixture:
    """(tokens, p) and target weights -> the mixture whose expected totals are the targets' shares of all tokens.

    `scale`: the expected tokens of the result over those of the input; by default as many as let every domain with a
    target keep at least `headroom` (1.25) times what it has, so that a mixture repeats rather than drops: a document
    of such a domain is then wanted at least once, even if a little of it looks like a domain to leave out.  A domain
    without a target has target 0.

    Plain gradient steps end when no total moves by more than `close` of its target (of all tokens, where that is 0),
    or after `steps`.  A small move is not a small distance: unless every total is then within `close` of its target,
    scaled steps follow (settled(), at most `exact` passes).  `reached` has the totals; they are off where no rates
    >= 0 have those of the targets, as of a domain with target 0 that every document belongs to a little: the nearer
    such a total comes to 0, the more documents have rate 0, down to a few with very high rates.  `zero_pull` says
    how much that domain's distance weighs against rates far from 1 (less: nearer to 0).
    """
    k = len(domains)
    weight = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    at = {"rows": members.select("tokens", "p", F.lit(1.0).alias("_r0")), "steps": 0}

    def seen(mixture):
        if len(mixture.history) - at["steps"] > keep_every:
            at["rows"] = staged(at["rows"].select("tokens", "p", mixture.rate(F.col("p"), F.col("_r0"), at["steps"]).alias("_r0")), "rates")
            at["steps"] = len(mixture.history)
        return at["rows"].select("tokens", "p", mixture.rate(F.col("p"), F.col("_r0"), at["steps"]).alias("_r"))

    totals = [F.sum(F.col("_r") * F.col("tokens") * F.col("p")[d]).alias(f"s{d}") for d in range(k)]
    sums = lambda mixture: [x or 0.0 for x in seen(mixture).agg(*totals).first()]
    mixture = Mixture(domains, [], 1.0)
    have = mixture.reached = sums(mixture)
    total, wanted = sum(have), sum(weight)
    if not total or not wanted:
        return Mixture(domains, [], 0.0, have, have)
    if scale is None:
        scale = (headroom or 1.25) * max([h / (w / wanted) for h, w in zip(have, weight) if w and h] or [total]) / total
    aim = mixture.aim = [scale * total * w / wanted for w in weight]
    base = [max(h, 1e-9 * total) for h in have]
    now = have
    for _ in range(steps):
        mixture.history.append([(s - a) / b for s, a, b in zip(now, aim, base)])
        was, now = now, sums(mixture)
        if all(abs(s - w) <= close * (a or total) for s, w, a in zip(now, was, aim)):
            break
    mixture.reached = now
    if any(abs(s - a) > close * a for s, a in zip(now, aim)):
        y, mixture.reached = settled(members, aim, base, [1e-8 if x else zero_pull for x in aim], close, exact)
        mixture.history, mixture.step = [y], 1.0
    return mixture


def settled(members: DataFrame, aim: list[float], base: list[float], least_pull: list[float], close: float = 1e-4, passes: int = 80) -> tuple[list[float], list[float]]:
    """y and the totals of the rates max(0, 1 - p_i y) that minimise the squared distances plus a small pull to rate 1.

    With pulls e_d, by which each domain's squared distance is divided, the least squares have one minimiser, where
    e_d base_d y_d = totals_d - aim_d; its rates are where projected gradient steps stand still.  y minimises a convex function of as many numbers as there are domains, whose value,
    gradient (the totals) and curvature (sums over the documents with a rate over 0) one pass gives; steps are halved
    until they lower it.  The pull goes down a hundredfold each time the gradient is within `close` of every domain's own
    target or total, to each domain's `least_pull`.
    """
    k, a, b, least = len(aim), np.array(aim), np.array(base), np.array(least_pull)
    pairs = [(d, e) for d in range(k) for e in range(d, k)]
    p = F.col("p")
    none = F.size("p") - k  # 0, but Spark does not know it

    def seen(y):
        # Numbers looked up by a row are not written into the generated code, so the driver compiles it once and not for every pass.
        numbers, r = F.array(*(F.lit(float(x)) for x in y)), F.lit(1.0)
        for d in range(k):
            r = r - p[d] * numbers[none + d]
        r = F.greatest(F.lit(0.0), r)
        weighed = members.select("p", r.alias("_r"), (r * F.col("tokens")).alias("_rt"), F.when(r > 0, F.col("tokens")).alias("_t"))
        row = weighed.agg(F.sum(F.col("_r") * F.col("_rt")), *(F.sum(F.col("_rt") * p[d]) for d in range(k)), *(F.sum(F.col("_t") * p[d] * p[e]) for d, e in pairs)).first()
        v = [x or 0.0 for x in row]
        bend = np.zeros((k, k))
        for (d, e), x in zip(pairs, v[k + 1 :]):
            bend[d, e] = bend[e, d] = x
        return v[0] / 2, np.array(v[1 : k + 1]), bend

    y, pull, n = np.zeros(k), np.maximum(1.0, least), 1
    value, s, bend = seen(y)
    while n < passes:
        slope = pull * b * y + a - s
        if (np.abs(slope) <= close * np.maximum(np.maximum(a, s), 1e-9 * b.sum())).all():
            if (pull <= least).all():
                break
            pull = np.maximum(pull / 100, least)
            continue
        step = np.linalg.solve(bend + np.diag(pull * b), -slope)
        height = lambda y, value: value + (pull * b * y * y).sum() / 2 + (a * y).sum()  # noqa: B023, E731
        size, before = 1.0, height(y, value)
        while n < passes:
            tried = seen(y + size * step)
            n += 1
            if height(y + size * step, tried[0]) <= before + 1e-4 * size * (slope * step).sum() + 1e-12 * abs(before):
                break
            size /= 2
        y, (value, s, bend) = y + size * step, tried
    return y.tolist(), s.tolist()


def copies(rate: Column, *seed: Column, keep_once: bool = False) -> Column:
    """The rate's floor, or one more for a share of documents drawn by a hash: the rate, on average.

    `keep_once`: at least one from a rate of a half on, which gives such domains more than their targets.
    """
    draw = F.pmod(F.xxhash64(*seed, F.lit("copies")), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return (F.greatest(drawn, F.when(rate >= 0.5, 1).otherwise(0)) if keep_once else drawn).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], headroom: float | None = None, zero_pull: float = 3e-2) -> DataFrame:
    """The documents themselves, each as often as mix() says, with the columns of `docs`, whatever they are called.

    `zero_pull` is larger than in mix(), so documents that only look a little like a domain to leave out stay.
    Texts are cut into words and scored once, and written beside their rows.  Null and empty texts have a rate by
    their posteriors like any other; rows that repeat do so on top of it; without labels all stay; an empty table
    gives an empty result.
    """
    fitted = fit_domains(docs, labels)
    if fitted is None:
        return docs
    seen = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(posteriors(seen, fitted).select("_row", "doc_id", "tokens", "p"), "scored")
    mixture = fit_rates(rows, fitted[1], targets, headroom=headroom, zero_pull=zero_pull)
    rows = rows.withColumn("_n", copies(mixture.rate(F.col("p")), F.col("doc_id")))
    return rows.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(doc_id, text) and labels (doc_id, domain) -> doc_id, tokens, p_<domain>..., rate, copies.

    Null and empty texts have no tokens; their rate follows from their posteriors like any other.  Without usable
    labels or targets all rates are 1.  Rows stay as often as they come, other columns are left out, and an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = fit_domains(docs, labels)
    domains = fitted[1] if fitted else ["all"]
    members = staged(posteriors(docs, fitted).select("doc_id", "tokens", "p"), "members")
    mixture = fit_rates(members, domains, targets) if fitted else Mixture(domains, [], 0.0)
    out = members.withColumn("rate", mixture.rate(F.col("p")))
    return out.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
