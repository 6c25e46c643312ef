"""Language identification in two levels: first the family, then one-versus-one linear SVMs within it.

Features are the relative counts of hashed letter bi- and trigrams of the whole lower-cased text.  Both levels are
fitted on the driver from a bounded sample of labelled documents; prediction is a scan.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 1 << 12
#: Families of common language codes.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "indic": "hi bn mr gu pa ur ne".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
}
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # letters of ASCII and all other bytes


def features(texts) -> np.ndarray:
    """A row of relative, square-rooted n-gram counts for each text (all zero without letters)."""
    out = np.zeros((len(texts), DIM), np.float32)
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").lower().encode().translate(_KEEP), np.uint8)
        row = np.zeros(DIM, np.int64)
        for at in range(0, len(raw), 1 << 20):  # a few MB at a time, however long the text is
            b = np.concatenate([[32], raw[max(0, at - 2) : at + (1 << 20)], [32]]).astype(np.uint32)
            two = b[:-1] * np.uint32(257) + b[1:]
            solid = (b[:-1] != 32) | (b[1:] != 32)
            three = two[:-1] * np.uint32(263) + b[2:]
            inner = (b[1:-1] != 32) & solid[:-1]
            for grams in (two[solid], three[inner]):
                row += np.bincount(grams * np.uint32(2654435761) >> np.uint32(20), minlength=DIM)
        if total := row.sum():
            out[k] = np.sqrt(row / total)
    return out


def _hinge(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 30) -> np.ndarray:
    """Weights (with a bias) of a linear SVM by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(x)).tolist():
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class LanguageModel:
    """`families`: {family: [languages]}; `votes`: for two groups of languages, the weights of their SVM."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]] = FAMILIES):
        of = {code: name for name, codes in families.items() for code in codes}
        langs = np.array(langs, dtype=object)
        self.families: dict[str, list[str]] = {}
        for code in sorted(set(langs)):
            self.families.setdefault(of.get(code, code), []).append(code)
        family = np.array([of.get(code, code) for code in langs], dtype=object)
        self.top = self._pairs(x, family, sorted(self.families))
        self.within = {name: self._pairs(x, langs, codes) for name, codes in self.families.items()}

    @staticmethod
    def _pairs(x, y, names) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i, j in combinations(range(len(names)), 2):
            rows = np.flatnonzero((y == names[i]) | (y == names[j]))
            out.append((i, j, _hinge(x[rows], np.where(y[rows] == names[i], 1.0, -1.0))))
        return out

    @staticmethod
    def _share(x: np.ndarray, pairs, n: int) -> np.ndarray:
        """For each row the n classes' shares: each pair's margin, squashed, is split between its two."""
        share = np.zeros((len(x), n)) + (n == 1)
        for i, j, w in pairs:
            p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
            share[:, i] += p
            share[:, j] += 1 - p
        return share / np.maximum(share.sum(1, keepdims=True), 1e-12)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The best language of the best family, and the family's share times the language's within it.

        A class beats all others of n with a share of 2/n, so shares are scaled by that to lie in 0 to 1.
        """
        names = sorted(self.families)
        top = self._share(x, self.top, len(names))
        best = top.argmax(1)
        out, score = np.empty(len(x), object), top.max(1) * max(1, len(names) / 2)
        for k, name in enumerate(names):
            rows, codes = np.flatnonzero(best == k), self.families[name]
            share = self._share(x[rows], self.within[name], len(codes))
            out[rows] = np.array(codes, object)[share.argmax(1)] if len(rows) else None
            score[rows] *= share.max(1) * max(1, len(codes) / 2) if len(rows) else 1
        return out.tolist(), np.clip(score, 0.0, 1.0)


def held_out():
    """Documents that no model learns from: crc32 of doc_id as text leaves 2 when divided by 4 (null: never)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, most: int = 1600) -> LanguageModel | None:
    """Learns from (doc_id, text, lang): rows with a letter and a language that are not held out.

    `most` bounds the sample over all languages (each gets an equal share, chosen by a hash of doc_id); a language
    with fewer rows gives all.  None if there is nothing to learn from.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    each = max(8, most // len(counts))
    part = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * each / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(1 << 30)

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                x = features(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array([r.tobytes() for r in x])], names=["lang", "x"])

    got = rows.where(draw < part[F.col("lang")]).select("text", "lang").mapInArrow(vectors, "lang string, x binary").limit(2 * most + 64 * len(counts)).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return LanguageModel(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got])


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(row, lang, score): the rows of `docs` as structs, of which only `text` is looked at, so any column may be beside it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                langs, score = ["und"] * some.num_rows, np.zeros(some.num_rows)
                text = some.column("seen")
                known = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False)) if model else []
                if len(known):
                    names, score[known] = model.predict(features(text.take(pa.array(known)).to_pylist()))
                    for k, name in zip(known.tolist(), names):
                        langs[k] = name
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(langs, pa.string()), pa.array(score)], names=["row", "lang", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.when(text.rlike(r"\p{L}"), text).alias("seen"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score for every whole text, by its text alone.

    A null text or one without a letter, and any text where there is no model, is `und` with score 0.  Rows stay as
    often as they come; an empty table gives an empty result; other columns are left out.
    """
    found = with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("row.doc_id", F.col("lang").alias("lang_pred"), "score")


def in_a_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with it as their lang; the columns of `docs`, whatever they are called.

    Null texts and texts without a letter go.  Rows that repeat stay as often as they come; where nothing is labelled
    no language is known and none stays; an empty table gives an empty result.
    """
    found = with_language(docs, fit_languages(docs)).where("lang <> 'und'")
    kept = [F.col("lang") if c.lower() == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*kept)
