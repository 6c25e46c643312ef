"""Every corpus operator against brute force on small tables with awkward rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import common, digest, language, mixing, neighbours, packing, queries, sharding, simhash, token_store, url_rules, warc

SF = "/root/testdata/sf0.001"
BPE = queries.byte_bpe()
LONG = "Long text with a naïve café and 日本語. " * 4000
TEXTS = [
    (5, "One two three four five six."), (1, None), (2, ""), (3, "   \n\t "), (9, "One two three four five six."), (7, "one  TWO three\nfour five six. "), (12, LONG),
    (13, LONG + "tail"), (14, "a"), (15, "\x1c odd \x85 spaces \u2003 and <|endoftext|> it's"), (16, "12 34 !!"), (17, "ＦＵＬＬ width ﬁ"), (9, "One two three four five six."), (None, "no id"), (21, "Ünïcödé é\u0301 x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fingerprint int, _r int, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or ""), "x", 1, 2, 3) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def order(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))


# --- helpers ------------------------------------------------------------------------------------------------------
def test_gapless_rank_and_hot_lookup(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    got = common.gapless_rank(df, ["k"], ["id"], 1000, "n", per_bucket=50).toPandas()
    assert all(sorted(g.n) == list(range(len(g))) for _, g in got.groupby("k"))
    right = df.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("top")).where("k <> 800")
    got = common.hot_lookup(df, right, "k", 1000, share=10).toPandas().set_index("id").top
    assert len(got) == 1000 and (got[got.index < 700] == 699).all() and np.isnan(got[800]) and got[900] == 900


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(900, 901)]
    got = common.connected(spark.createDataFrame(edges, "a long, b long")).toPandas().set_index("id").component
    assert (got[got.index <= 200] == 0).all() and got[901] == 900
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 sharding -----------------------------------------------------------------------------------------------------
def check_shards(pdf, n, shards):
    sizes = pdf.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(pdf) == n and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in pdf.groupby("shard"))


def test_sharding(spark, docs, real, empty):
    out = sharding.shard_documents(docs, 4).toPandas()
    check_shards(out, len(TEXTS), 4)
    sizes = {(i, t): len((t or "").encode()) + 8 for i, t in TEXTS}
    assert Counter(out["size"]) == Counter(sizes[x] for x in TEXTS)
    assert Counter(out.text_crc32) == Counter(zlib.crc32((t or "").encode()) for _, t in TEXTS)
    whole = sharding.shard_documents(real, 24).toPandas()
    check_shards(whole, real.count(), 24)
    cut = whole.groupby("text_crc32").shard.nunique()
    assert (cut > 1).mean() < 0.05
    assert sharding.shard_documents(empty, 24).count() == 0


def test_sharding_group_larger_than_a_shard(spark):
    """A third of all rows are copies: they fill whole shards, and two shards hold a part at most."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(2400)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).toPandas()
    check_shards(out, 2400, 24)
    hot = out[out.text_crc32 == zlib.crc32(b"hot")].groupby("shard").size()
    assert len(hot) <= 10 and (hot == 100).sum() >= 6


def test_sharding_where_every_text_occurs_twice(spark):
    """All shards are full from the start, so only exchanges bring copies together."""
    n = 4808
    rows = [(i, f"text {i * 7919 % n // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, 24)
    check_shards(out.toPandas(), n, 24)
    start = df.select(F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.col("doc_id") % 24).alias("shard"))
    assert sharding.cut_share(start, "text_crc32") > 0.4 and sharding.cut_share(out, "text_crc32") < 0.1


def test_sharding_by_two_links(spark):
    """Votes of both links meet by joins: cut edges counted one by one fall, sizes stay even, null links link nothing."""
    rng, n = np.random.default_rng(12), 1200
    host = rng.integers(0, 60, n)
    pdf = pd.DataFrame({"node": np.arange(n), "host": host, "topic": host // 6 * 10 + rng.integers(0, 3, n)}).astype("Int64")
    pdf.loc[rng.random(n) < 0.1, "host"] = pd.NA
    pdf.loc[rng.random(n) < 0.1, "topic"] = pd.NA
    rows = [tuple(None if v is pd.NA else int(v) for v in r) for r in pdf.itertuples(index=False)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "node long, host long, topic long"), ["host", "topic"], 8).toPandas()
    check_shards(out, n, 8)
    shard = out.set_index("node").shard

    def cut_edges(at):
        total = cut = 0
        for link in ("host", "topic"):
            for _, group in pdf.dropna(subset=[link]).groupby(link):
                s = at[group.node.to_numpy(dtype=int)].to_numpy()
                total += len(s) * (len(s) - 1) // 2
                cut += sum(int(s[i] != s[j]) for i in range(len(s)) for j in range(i))
        return cut / total

    assert cut_edges(shard) < 0.45 < 0.8 < cut_edges(pd.Series(np.arange(n) % 8, index=np.arange(n)))

def test_admitted_proposals_keep_loads_within_quotas():
    rng = np.random.default_rng(6)
    for _ in range(50):
        flows = [(f, t, g, int(rng.integers(1, 30))) for f in range(5) for t in range(5) for g in range(3) if f != t and rng.random() < 0.6]
        room = rng.integers(0, 20, 5).tolist()
        got = sharding._admitted(flows, room)
        asked = {x[:3]: x[3] for x in flows}
        assert all(0 < n <= asked[f, t, g] for f, t, g, n in got)
        net = [sum(n for f, t, _, n in got if t == s) - sum(n for f, t, _, n in got if f == s) for s in range(5)]
        assert all(x <= r for x, r in zip(net, room))


# --- 2 token store --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("ends", [[0], [5], [1, 1, 1, 9], list(range(0, 5000, 7)), [0, 0, 0, 100000], []])
def test_elias_fano(ends):
    ef = token_store.EliasFano.of(np.array(ends, np.int64), ends[-1] if ends else 0)
    assert ef.values().tolist() == ends and [ef.select(i) for i in range(len(ends))] == ends


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000))
    ef = token_store.EliasFano.of(ends, int(ends[-1]))
    bits = 8 * (len(ef.low) + len(ef.high) + ef.marks.nbytes) / len(ends)
    assert bits < 2.6 + np.log2(ends[-1] / len(ends))


@pytest.mark.parametrize("shard_ids", [10, 1 << 21])
def test_token_store(spark, docs, empty, tok, shard_ids):
    token_store.write_token_shards(docs, path := common.new_dir(spark, "t"), BPE, 2, shard_ids)
    got = token_store.read_token_shards(spark, path).toPandas().sort_values(["start"])
    at = 0
    for (i, text), r in zip(order(docs), got.itertuples()):
        ids = np.array(tok(text) + [2], "<u4")
        assert (pd.isna(r.doc_id) if i is None else r.doc_id == i) and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert len(got) == len(TEXTS)
    some = {r.doc_id: r.ids for r in token_store.read_documents(spark, path, spark.createDataFrame([(12,), (14,), (14,), (99,)], "doc_id long")).collect()}
    assert some == {12: tok(LONG) + [2], 14: tok("a") + [2]}
    token_store.write_token_shards(empty, path := common.new_dir(spark, "t"), BPE, 2)
    assert token_store.read_token_shards(spark, path).count() == 0


# --- 3 language -----------------------------------------------------------------------------------------------------
def test_language_held_out(spark, real):
    out = language.identify(real, language.fit_languages(real)).join(real.select("doc_id", "lang"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id])
    assert (out.lang_pred == out.lang)[held].mean() >= 0.95 and out.score.between(0, 1).all()


def test_language_edges(spark, docs, real, empty):
    model = language.fit_languages(real)
    got = {(None if pd.isna(r.doc_id) else r.doc_id): (r.lang_pred, r.score) for r in language.identify(docs, model).toPandas().itertuples()}
    assert got[1] == got[2] == got[3] == got[16] == ("und", 0.0)
    assert got[12][0] != "und" and len(got) == len({i for i, _ in TEXTS})
    assert language.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language.fit_languages(empty) is None and language.identify(empty, model).count() == 0
    kept = language.in_a_language(real.unionByName(docs.select(*real.columns)))
    assert kept.columns == real.columns and kept.where("doc_id is null or text is null").where("text is null").count() == 0


def test_language_features_do_not_depend_on_blocks():
    one = language.features(["ab cd " * 300_000])[0]
    two = language.features(["ab cd " * 3])[0]
    assert np.abs(one - two).max() < 0.1


# --- 4 digests ------------------------------------------------------------------------------------------------------
def canon(s):
    for _ in range(2):
        s = unicodedata.normalize("NFKC", s).casefold()
    s = unicodedata.normalize("NFKC", s)
    return re.sub(r"[ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", s).strip(" ")


@pytest.mark.parametrize("which", ["docs", "real"])
def test_digests(request, which):
    df = request.getfixturevalue(which)
    rows = order(df)
    got = digest.digests(df).toPandas()
    edited = []
    for k, (_, t) in enumerate(rows):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half])
    assert Counter(got.edited_sha256) == Counter(hashlib.sha256(e.encode()).hexdigest() for e in edited)
    by = {}
    for (i, t), e in zip(rows, edited):
        by.setdefault((i, len(t), hashlib.sha256(e.encode()).hexdigest()), (canon(t), canon(e)))
    seen = {}
    for r in got.itertuples():
        c, e = by[(None if pd.isna(r.doc_id) else r.doc_id, r.n_chars, r.edited_sha256)]
        assert seen.setdefault(c, r.fingerprint) == r.fingerprint and seen.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_edited == float(c == e)
    assert len(set(seen.values())) == len(seen)


def test_digest_buckets_are_compared_by_bytes(spark):
    forms = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 1, "x"), (2, 1, "z")], "h1 long, h2 long, canon string")
    got = digest.bucket_classes(forms).collect()
    assert sorted((r.h1, r.place) for r in got) == [(1, 0), (1, 1)]


def test_digests_tell_colliding_texts_apart(spark, monkeypatch):
    """With a digest that is only the text's length, equal buckets are common, and bytes decide."""
    monkeypatch.setattr(digest, "wide_hash", lambda c: (F.char_length(c).cast("long"), F.lit(0).cast("long")))
    texts = ["aaaa", "bbbb", "AAAA", "abcd", "zz", "zz", "abbb", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = digest.digests(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    edit = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in rows]
    seen = {}
    for i, t in rows:
        assert seen.setdefault(canon(t), got.fingerprint[i]) == got.fingerprint[i] and seen.setdefault(canon(edit[i]), got.edited_fingerprint[i]) == got.edited_fingerprint[i]
    assert len(set(seen.values())) == len(seen)


def test_digests_fold_case(spark):
    rows = [(1, "Straße"), (2, "STRASSE"), (3, "ΟΔΟΣ"), (4, "οδοσ"), (5, "οδος"), (6, "ﬁn"), (7, "FIN"), (8, "strase")]
    got = digest.digests(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").fingerprint
    assert got[1] == got[2] and got[3] == got[4] == got[5] and got[6] == got[7] and got.nunique() == 4


def test_with_next_of_repeated_and_null_ids(spark):
    """A third of the rows has one doc_id and a third none; the successors of all rows form one ring."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: r.next_text for r in digest.with_next(df, {}, ["text"]).collect()}
    ids, at, seen = {t: i for i, t in rows}, "text 0", []
    for _ in rows:
        seen.append(at)
        at = got[at]
    assert at == "text 0" and len(set(seen)) == 600
    turn = [(ids[t] is not None, ids[t] or 0) for t in seen]
    assert sum(a > b for a, b in zip(turn, turn[1:] + turn[:1])) == 1


def test_digests_of_one_and_none(spark, empty):
    one = digest.digests(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert digest.digests(empty).count() == 0


# --- 5 WARC ---------------------------------------------------------------------------------------------------------
PAGES = [(3, "http://a/x y", "h" * 200), (1, None, "h" * 200), (2, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 60), (7, "u\r\nX: y", "é" * 60), (None, "u", "h" * 200), (8, "u", LONG * 10), (8, "u", LONG * 10)]


def test_warc(spark):
    df = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, first int, digest string")
    path = common.new_dir(spark, "w")
    files = warc.write_archives(warc.with_revisits(df), path)
    for split in (100, 5000, 8 << 20):
        got = warc.read_archives(spark, path, files, split).toPandas()
        assert len(got) == len(PAGES)
        want = Counter()
        for i, _, h in PAGES:
            b = (h or "").encode()
            first = min([j for j, _, g in PAGES if g == h and j is not None], default=None)
            ref = first if len(b) >= 100 and i != first else None
            want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref)] += 1
        assert Counter((None if pd.isna(r.page_id) else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in got.itertuples()) == want
    assert warc.archive_pages(df.limit(0), common.new_dir(spark, "w")).count() == 0


def test_warc_skips_false_magic(tmp_path):
    import gzip

    from pyarrow.fs import LocalFileSystem

    real = warc.record(1, "u", b"body" * 50, "d", None)
    fake = gzip.compress(b"not a record") + warc.MAGIC + b"garbage"
    name = tmp_path / "f.gz"
    name.write_bytes(fake[: len(gzip.compress(b"not a record"))] + real + warc.record(2, "u", b"", "d", None))
    fs = LocalFileSystem()
    size = name.stat().st_size
    assert [warc.parse(m)[0]["x-page-id"] for m in warc.members(fs, str(name), 0, size)] == ["1", "2"]
    parts = [warc.parse(m)[0]["x-page-id"] for a in range(0, size, 37) for m in warc.members(fs, str(name), a, min(a + 37, size), step=16)]
    assert parts == ["1", "2"]


# --- 6 neighbours ---------------------------------------------------------------------------------------------------
def exact(ids, x, queries, k=5):
    out = {}
    for q in queries:
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        rest = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in rest]
    return out


def test_neighbours_recall(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest(pdf, pdf.where("vec_id % 50 = 0"), 5).toPandas().sort_values(["query_id", "rank"])
    ids, x = zip(*[(r.vec_id, r.embedding) for r in pdf.collect()])
    ids, x = np.array(ids), np.array(x, float)
    want = exact(ids, x, np.flatnonzero(ids % 50 == 0))
    hits = sum(len({v for v, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.9
    score = {(q, v): s for q, n in want.items() for v, s in n}
    assert all(abs(score[(r.query_id, r.vec_id)] - r.score) < 1e-12 for r in got.itertuples() if (r.query_id, r.vec_id) in score)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df, df.where("vec_id in (0, 2, 8)"), 5).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [1, 6, 7] and set(got.query_id) == {0} and got["rank"].tolist() == [1, 2, 3]
    assert neighbours.nearest(df.limit(0), df, 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(same, same.where("vec_id = 200"), 5, block=64, chunk=1).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [0, 1, 2, 3, 4]


def test_neighbours_repeats_scales_and_parts(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8))
    x[:200] = x[0]  # many equal vectors: ties go to the smaller id
    big = [(i, (v * 2.0 ** (600 if i % 2 else -600)).tolist()) for i, v in enumerate(x)]
    rows = big + [(5, x[0].tolist()), (699, [9.0] * 8), (650, big[650][1])]  # ids that repeat count once, with the smallest vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5, block=256, part=64).toPandas().sort_values(["query_id", "rank"])
    y = np.array([min(v for i, v in rows if i == k) for k in range(700)])
    y = y / np.abs(y).max(1, keepdims=True)
    want = exact(np.arange(700), y, range(0, 700, 50))
    assert got.groupby("query_id").size().eq(5).all() and np.isfinite(got.score).all() and not got.duplicated(["query_id", "vec_id"]).any()
    assert got[got.query_id == 100].vec_id.tolist() == [v for v, _ in want[100]] == [0, 1, 2, 3, 4]
    assert all(abs(dict(want[r.query_id]).get(r.vec_id, r.score) - r.score) < 1e-12 for r in got.itertuples())
    assert sum(len({v for v, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id")) >= 0.9 * 5 * 14


def test_rotations_are_at_right_angles():
    a = neighbours.rotations(16, 40)
    assert a.shape == (16, 40) and np.allclose(a[:, :16].T @ a[:, :16], 16 * np.eye(16)) and np.allclose((a * a).sum(0), 16)


# --- 7 packing ------------------------------------------------------------------------------------------------------
def best_fit(items, cap):
    gaps = []
    for x in sorted(items, reverse=True):
        fit = [g for g in gaps if g >= x]
        g = min(fit) if fit else cap
        if fit:
            gaps.remove(g)
        gaps.append(g - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([10, 100, 2048]))
    items = rng.integers(1, cap + 1, rng.integers(1, 300)).tolist()
    plan = packing.Plan(dict(Counter(items)), cap)
    bins = {}
    for s, _, n, first, each, at in plan.rules:
        for j in range(n):
            bins.setdefault(first + j // each, []).append((at + j % each * s, s))
    assert Counter(s for b in bins.values() for _, s in b) == Counter(items) and sorted(bins) == list(range(plan.bins))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(s for _, s in b)])[:-1].tolist() and sum(s for _, s in b) <= cap
        assert sum(3 * s > cap for _, s in b) <= 2
    assert plan.bins <= best_fit(items, cap) + 1


def test_packing(spark, docs, empty, tok):
    got = packing.pack_documents(docs, BPE, 0, 64).toPandas()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array(tok(t) + [0], "<u4")
        first = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 64
    assert packing.pack_documents(empty, BPE).count() == 0


# --- 8 SimHash ------------------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def labels_of(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            return label
        label = new


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in a], dtype=np.uint64)
    keys = [dict() for _ in range(2)]
    for side, fps in enumerate((a, a ^ flips)):
        at, key = simhash.golay_keys(fps)
        for i, k in zip(at.tolist(), key.tolist()):
            keys[side].setdefault(i, set()).add(k)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_golay_code_is_perfect():
    errors = simhash.near_errors()
    weight = np.bitwise_count(errors[:, 0])
    assert (simhash.syndrome(errors[:, 0]) == np.arange(2048)).all() and weight.max() == 3
    assert ((errors >= 0).sum(1) == np.where(weight == 3, 6, 1)).all()


@pytest.mark.parametrize("most", [4, 200_000])
def test_near_links_are_brute_force(spark, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 20)
    fps = {int(b) for b in base}
    for b in base:  # clusters around some centers, a chain, and far ones
        for _ in range(40):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False)))
    fps = np.array(sorted(fps))
    points = spark.createDataFrame(pd.DataFrame({"fp": fps, "id": np.arange(len(fps))}))
    got = common.connected(simhash.near_links(points, most)).toPandas().set_index("id").component.reindex(range(len(fps)))
    got = got.fillna(pd.Series(range(len(fps)))).astype(int)
    assert (got.to_numpy() == labels_of(np.arange(len(fps)), fps.astype(np.uint64))).all()


@pytest.mark.parametrize("which", ["docs", "real"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df).toPandas()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    ids = np.array([1 << 59 if i is None else i for i, _ in rows])
    label = labels_of(ids, fps)
    want = Counter((i, f"{f:016x}", None if c == 1 << 59 else int(c)) for (i, _), f, c in zip(rows, fps.tolist(), label))
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.fingerprint, None if pd.isna(r.component_id) else int(r.component_id)) for r in got.itertuples()) == want


def test_deduplicated(docs, empty):
    kept = simhash.deduplicated(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(9) == 0 and ids.count(5) == 1 and None in ids and len(ids) == len(set(ids))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


# --- 9 URL rules ----------------------------------------------------------------------------------------------------
URLS = [None, "", "example.com/en/", "http://example.com/en/x", "HTTP://WWW.Example.COM/en/1?q#f", "http://a.www.example.com/en/", "http://badexample.com/en/", "http://x.net/es/", "http://net/fr/?", "http://x.net", "http://com", "http://com/", "ftp://u@h.com:80/x", "a://b://c.com/", "http://example.com\n/en/x", "http:///path", "http://x.com#/y", "http://com\x01x/", "http://a\x02.com\x01.x.com/", "http://\x01.com/"]


def slow_judge(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: x[:2], default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    rules = queries.URL_RULES + [("", "", "block"), ("a.b.c.d", "/", "block"), ("d", "/x/y", "allow"), ("c.d", "/x", "block")]
    urls = URLS + [f"http://{h}.d/x/y/{k}" for k in range(60) for h in ("a.b.c", "z.a.b.c", "c", "b.c", "cc")]
    pages = spark.createDataFrame([(k, u, "v", 1) for k, u in enumerate(urls)], "page_id long, url string, verdict string, range int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge(pages, table).toPandas().set_index("page_id").sort_index()
    for k, u in enumerate(urls):
        r = got.loc[k]
        assert (r.host, r.path, r.rule if isinstance(r.rule, str) else None, r.verdict) == slow_judge(u, rules), u
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert url_rules.judge(pages, table.limit(0)).where("rule is null and verdict = 'allow'").count() == len(urls)


# --- 10 mixing ------------------------------------------------------------------------------------------------------
def test_mixing_reaches_targets(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(real, queries.domain_labels(spark, "/root/testdata/sf0.01"), queries.TARGETS).toPandas()
    assert len(out) == real.count() and (out.rate >= 0).all()
    total = {d: (out.tokens * out[f"p_{d}"] * out.rate).sum() for d in queries.TARGETS}
    assert total["plain"] / total["good"] == pytest.approx(15 / 85, rel=0.05) and total["toxic"] < 0.05 * total["good"]
    used = {d: (out.tokens * out[f"p_{d}"] * out.copies).sum() for d in queries.TARGETS}
    assert used["good"] == pytest.approx(total["good"], rel=0.05) and used["plain"] == pytest.approx(total["plain"], rel=0.05)
    assert (out.copies - out.rate).abs().max() < 1 and abs((out.copies - out.rate).mean()) < 0.05  # no fraction is rounded one way
    lab = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").df()
    seen = out.merge(lab, on="doc_id")
    assert (seen[seen.toxic == 1].copies == 0).mean() > 0.9 and (seen[seen.toxic == 0].copies > 0).mean() > 0.97


def test_rates_are_projected_least_squares(spark):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 50, 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens long, p array<double>")
    m = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2}, steps=200, close=1e-9)
    rate = np.array([r[0] for r in members.select(m.rate(F.col("p"))).collect()])
    have = (t[:, None] * p).sum(0)
    aim = 1.25 * np.array([0.5, 0.3, 0.2]) * max(have / [0.5, 0.3, 0.2])
    r = np.ones(300)
    for _ in m.history:
        r = np.maximum(0, r - p @ ((((r * t)[:, None] * p).sum(0) - aim) / have))
    assert np.allclose(rate, r) and np.allclose(((rate * t)[:, None] * p).sum(0), aim, rtol=1e-3)


def test_rates_of_a_domain_to_leave_out(spark):
    """A zero target against long accelerated projected-gradient descent on the same objective, and against its optimum."""
    rng = np.random.default_rng(8)
    p, t = rng.dirichlet([0.4, 0.4, 0.2], 250), rng.integers(1, 50, 250)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens long, p array<double>").cache()
    have, weight = (t[:, None] * p).sum(0), np.array([0.7, 0.3, 0.0])
    for zero_pull in (1e-2, 1e-4):
        m = mixing.fit_rates(members, ["a", "b", "zero"], {"a": 0.7, "b": 0.3}, scale=1.0, zero_pull=zero_pull)
        rate = np.array([r[0] for r in members.select(m.rate(F.col("p"))).collect()])
        reached, aim = ((rate * t)[:, None] * p).sum(0), weight * have.sum()
        assert np.allclose(m.aim, aim) and np.allclose(m.reached, reached) and np.allclose(reached[:2], aim[:2], rtol=1e-3)
        pull = np.array([1e-8, 1e-8, zero_pull])
        cost = lambda r: ((((r * t)[:, None] * p).sum(0) - aim) ** 2 / have / pull).sum() / 2 + (t * (r - 1) ** 2).sum() / 2  # noqa: B023, E731
        r, ahead, step = rate.copy(), rate.copy(), 1 / (np.linalg.norm(p * np.sqrt(t)[:, None] / np.sqrt(have * pull), 2) ** 2 + 1)
        for k in range(4000):  # goes on from the result: nothing may be left to gain
            new = np.maximum(0, ahead - step * (p @ ((((ahead * t)[:, None] * p).sum(0) - aim) / have / pull) + ahead - 1))
            r, ahead = new, new + k / (k + 3) * (new - r)
        assert cost(rate) <= cost(r) * (1 + 1e-3)
    assert reached[2] < 0.1 * have[2]


def test_rates_reach_rare_and_overlapping_targets(spark):
    """With the defaults: a domain below 1e-4 of all tokens, and posteriors that differ little."""
    rng = np.random.default_rng(3)
    a = np.clip(rng.normal(0.5, 0.05, 2000), 0.01, 0.99)
    p = np.stack([a, 1 - a, np.zeros(2000)], 1)
    p[:3] = [[0.1, 0.1, 0.8]] * 3
    t = np.where(np.arange(2000) < 3, 5, 100 + rng.integers(0, 50, 2000))
    members = spark.createDataFrame([(int(x), [float(y) for y in q]) for x, q in zip(t, p)], "tokens long, p array<double>").cache()
    m = mixing.fit_rates(members, ["a", "b", "rare"], {"a": 0.52, "b": 0.4799, "rare": 0.0001})
    rate = np.array([r[0] for r in members.select(m.rate(F.col("p"))).collect()])
    reached = ((rate * t)[:, None] * p).sum(0)
    assert (rate >= 0).all() and np.allclose(reached, m.reached) and np.allclose(reached, m.aim, rtol=1.01e-4)
    assert np.allclose(reached / reached.sum(), [0.52, 0.4799, 0.0001], rtol=1e-3)


def test_copies_are_unbiased(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 8 * 0.3).alias("rate"))
    got = df.select("rate", mixing.copies(F.col("rate"), F.col("id")).alias("n"), mixing.copies(F.col("rate"), F.col("id"), keep_once=True).alias("k")).groupBy("rate").agg(F.avg("n").alias("n"), F.min("k").alias("k")).toPandas()
    assert np.allclose(got.n, got.rate, atol=0.03) and (got.k[got.rate >= 0.5] >= 1).all()


def test_mixing_edges(spark, docs, empty):
    labels = spark.createDataFrame([(5, "good"), (9, "plain"), (9, "good"), (1, None), (None, "good")], "doc_id long, domain string")
    out = mixing.mix(docs, labels, {"good": 1.0, "plain": 1.0}).toPandas()
    assert len(out) == len(TEXTS) and (out.rate >= 0).all() and out.tokens.min() == 0
    none = mixing.mix(docs, labels.limit(0), {"good": 1.0}).toPandas()
    assert (none.rate == 1).all() and (none.copies == 1).all()
    assert mixing.mix(empty, labels, {"good": 1.0}).count() == 0
    kept = mixing.mixed(docs, labels.limit(0), {"good": 1.0})
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


# --- pipeline -------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, real, tok):
    docs, names = real, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == real.columns
        out.write.parquet(path := common.new_dir(spark, name))
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in real.collect()]
    label = labels_of(np.array([i for i, _ in rows]), np.array([slow_fingerprint(t) for _, t in rows], np.uint64))
    assert kept["language"] == {i for i, t in rows if re.search(r"[^\W\d_]", t or "")}
    assert kept["near_duplicates"] == set(label.tolist()) & kept["language"]
    toxic = {i for i, in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1").fetchall()}
    clean = {i for i, in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 0").fetchall()}
    gone = kept["near_duplicates"] - kept["mixing"]
    assert len(gone & toxic) >= 0.8 * len(kept["near_duplicates"] & toxic) and len(gone & clean) <= 0.05 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = sum(len(tok(r.text)) + 1 for r in docs.select("text").collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_stages_take_any_columns_and_rows(spark, docs, empty, real):
    """Columns whose names clash with those that stages make, null and empty texts, repeated rows, empty tables."""
    names = ["_letters", "_score", "_lang_pred", "row", "seen", "score", "_row", "_n", "_copy", "tokens", "p", "_words", "component_id", "fp", "least", "key"]
    more = lambda df: df.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    rows = more(real.unionByName(docs.select(*real.columns)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert stage(spark, more(empty), SF).count() == 0
        if name == "packing":
            assert out.agg(F.count_distinct("doc_id")).first()[0] == rows.agg(F.count_distinct("doc_id")).first()[0]
            continue
        assert out.columns == rows.columns
        kept = out.collect()
        assert kept and all(r[n] == k for r in kept for k, n in enumerate(names))
        assert {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in rows.collect()}
        if name == "language":
            rows = out


# --- queries with SQL -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in cols) for r in res.fetchall())))
