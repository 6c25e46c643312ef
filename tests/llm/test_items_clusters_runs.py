"""Decontamination, bit-plane clustering and word runs against brute force and SQL, with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import bit_planes, decontamination, queries, word_runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id string, win string, row int, n_words string, hash int"


def same_as_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.fetchall(), key=str)


# --- 11 decontamination -----------------------------------------------------------------------------------------------
def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(doc, item, window, shingle, least):
    """Words of `doc` within an occurrence of a window of `item`."""
    size, out = min(window, len(item)), set()
    k = min(shingle, size)
    for a in range(len(item) - size + 1 if item else 0):
        win = item[a : a + size]
        for p in range(len(doc) - size + 1):
            same = sum(doc[p + o : p + o + k] == win[o : o + k] for o in range(size - k + 1))
            if same >= least * (size - k + 1) - 1e-9:
                out |= set(range(p, p + size))
    return out


def brute_contamination(docs, items, window=10, shingle=3, least=1.0):
    out = []
    for doc_id, text in docs:
        doc, hit, ids = words(text), set(), set()
        for item_id, item in items:
            if found := hits(doc, words(item), window, shingle, least):
                hit |= found
                ids |= {item_id} - {None}
        out.append((doc_id, len(doc), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def contamination(spark, docs, items, **how):
    df = spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in docs], DOCS)
    it = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, row int")
    return sorted(map(tuple, decontamination.contamination(df, it, **how).collect()), key=str)


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(4)
    vocab = ["the", "of", "a", "é", "Über", "x1", "日本", *(f"w{i}" for i in range(60))]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([1, 2, 3, 4, 9, 10, 11, 25, 40]))) for k in range(30)]
    items += [("dup", items[5][1]), ("i3", say(12)), (None, say(14)), ("none", None), ("blank", " -- "), ("case", "The OF a é Über x1 日本 w1 w2 w3 w4")]
    docs = [(i, say(rng.choice([0, 1, 5, 30, 120]))) for i in range(40)]
    long = next(t for _, t in items if t and len(t.split()) > 20)
    docs += [(100 + i, f"{say(6)} -- {long.upper() if i % 2 else long}!\n{say(4)}") for i in range(20)]  # a hot passage
    docs += [(200, None), (201, ""), (202, "..."), (203, " ".join(t or "" for _, t in items)), (None, long), (7, long), (7, long), (204, "the of a é über X1 日本 w1 w2 w3 w4 " * 200)]
    docs += [(300 + i, " ".join(w if k % 9 else "changed" for k, w in enumerate(long.split(), i))) for i in range(9)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"window": 8, "shingle": 2}, {"window": 10, "shingle": 1, "least": 0.85}, {"window": 12, "shingle": 2, "least": 0.6}])
def test_contamination(spark, leaky, how):
    assert contamination(spark, *leaky, **how) == brute_contamination(*leaky, **how)


def test_contamination_of_empty_tables(spark, leaky):
    docs, items = leaky
    assert contamination(spark, [], items) == []
    assert contamination(spark, docs[:5], []) == brute_contamination(docs[:5], [])
    assert contamination(spark, docs[:5], [("a", None), (None, "")]) == brute_contamination(docs[:5], [])


def test_contamination_query(spark):
    same_as_sql(spark, "op11_decontamination")


# --- 12 clustering ------------------------------------------------------------------------------------------------------
def brute_clusters(rows, k, rounds, scale=1024):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    planes = lambda v: bit_planes.to_planes(np.array([v], object)).view(np.int64)[0].tolist()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), planes(r[1])))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centroids


def clusters(spark, rows, k=8, rounds=10):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, planes string")
    got, centroids = bit_planes.cluster(df, k, rounds)
    return got, sorted(map(tuple, got.collect()), key=str), centroids


def vectors(n, seed=0, spread=1.0):
    return [(i, (np.random.default_rng(seed + i).normal(size=64) * spread).astype(np.float32).tolist()) for i in range(n)]


def test_clusters(spark):
    odd = vectors(3, 500)
    rows = vectors(60) + [(1, vectors(1, 900)[0][1]), (1, vectors(1)[0][1]), (None, odd[0][1]), (70, None), (71, []), (72, odd[1][1][:63]), (73, odd[1][1] + [0.0])]
    rows += [(74, [float("nan"), *odd[2][1][1:]]), (75, [float("inf"), *odd[2][1][1:]]), (76, [None, *odd[2][1][1:]]), (77, [0.0] * 64), (78, [-1 / 1024] * 64), (79, [-0.0] * 64)]
    for k, rounds in ((8, 10), (3, 0), (100, 2)):
        want = brute_clusters(rows, k, rounds)
        _, got, centroids = clusters(spark, rows, k, rounds)
        assert (got, centroids) == want
    out = bit_planes.with_inertia(*clusters(spark, rows)[::2]).toPandas()
    want, centroids = brute_clusters(rows, 8, 10)
    assert (out.inertia == sum(r[2] for r in want)).all()
    for r in out.itertuples():
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_copies_ties_and_empty_tables(spark):
    """A third of all rows are one vector, which several first centroids equal: ties go to the smaller number, the others stay empty."""
    rows = [(i, vectors(1, 3)[0][1] if i % 3 else v) for i, v in vectors(90)]
    assert clusters(spark, rows)[1:] == brute_clusters(rows, 8, 10)
    assert clusters(spark, [])[1:] == ([], [])
    assert bit_planes.with_inertia(*clusters(spark, [])[::2]).count() == 0
    assert clusters(spark, vectors(2))[1:] == brute_clusters(vectors(2), 8, 10)


def test_clusters_of_huge_components(spark):
    """Components up to the largest float: sums and comparisons stay exact, distances beyond 64 bits are null."""
    rows = vectors(20, 1, 1e3) + [(100 + i, v) for i, v in vectors(10, 2, 3e36)]
    want, centroids = brute_clusters(rows, 4, 5)
    _, got, found = clusters(spark, rows, 4, 5)
    assert found == centroids and got == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=str)


def test_planes_and_popcounts():
    rng = np.random.default_rng(1)
    for low, high in ((-5, 4), (-4, 5), (0, 0), (-1, 0), (-(1 << 20), 1 << 20), (0, 1 << 26)):
        x, y = rng.integers(low, high + 1, (30, 64)), rng.integers(-9, 9, (5, 64))
        px, py = bit_planes.to_planes(x), bit_planes.to_planes(y)
        assert [bit_planes.from_planes(r) for r in px.tolist()] == x.tolist()
        assert (bit_planes.dots(px, py) == x @ y.T).all() and (bit_planes.own_dots(px) == (x * x).sum(1)).all()
        w = np.array(bit_planes.plane_weights(px.shape[1]))
        assert (w @ bit_planes.plane_counts(px) == x.sum(0)).all()
        assert (bit_planes.dots(np.hstack([px, px[:, -1:]]), py) == x @ y.T).all()  # a repeated sign changes nothing


def test_clusters_query(spark):
    same_as_sql(spark, "op12_clusters")


# --- 13 runs ------------------------------------------------------------------------------------------------------------
def brute_runs(s, least_length, least_exponent):
    out = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((i, n, q) for (i, n), q in out.items() if n >= max(least_length, least_exponent * q)), key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_and_runs():
    rng = random.Random(2)
    for _ in range(3000):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5 and s:
            a = rng.randrange(len(s))
            p = 1 + (len(s) - a) // rng.randint(2, 8)
            s = [x if i < a else s[a + (i - a) % p] for i, x in enumerate(s)]
        follow = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) for i in range(len(s))]
        assert word_runs.lyndon_lengths(s) == [j - i for i, j in enumerate(follow)]
        for how in ((2, 2), (6, 4), (3, 3), (5, 2.5)):
            assert word_runs.find_runs(np.array(s, np.int64), *how) == brute_runs(s, *how)
    with pytest.raises(ValueError):
        word_runs.find_runs(np.zeros(3, np.int64), 2, 1.5)


def brute_query(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w, 6, 4)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]  # documents whose words are made to repeat
    texts = [None, "", " \t\n", "a", "a a a a a a", "\x1c é é é é é é  é", "a b " * 900, "x\x0by\x0cz\r" * 5, "one two three " * 5 + "tail", " ".join(f"w{i}" for i in range(80)), "b a a a a a a b a a a a a a " * 6, "a b a b a b a b c " * 9]
    odd = [(i, t) for i in (1, None) for t in texts] + list(zip(chosen, texts)) + [(1, "a a a a a a")] * 30
    rows = [tuple(r) for r in real] + odd
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, _n int")
    got = word_runs.digest_runs(word_runs.word_runs(word_runs.with_repeats(df)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_query(*r) for r in rows), key=str)
    out = queries.op13_runs(spark, SF)
    assert out.columns == got.columns and sorted(map(tuple, out.collect()), key=str) == sorted((brute_query(*r) for r in real), key=str)
    assert word_runs.word_runs(df.where(F.lit(False))).count() == 0
