"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bit_planes import cluster, with_inertia
from .common import new_dir
from .decontamination import contamination
from .digest import digests
from .language import fit_languages, held_out, identify
from .mixing import mix
from .neighbours import nearest
from .packing import pack_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_store import read_token_shards, write_token_shards
from .url_rules import judge
from .warc import archive_pages
from .word_runs import digest_runs, with_repeats, word_runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_token_shards(table(spark, sf_dir, "documents"), path := new_dir(spark, "token-shards"), byte_bpe(), end_id=2)
    return read_token_shards(spark, path)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"), new_dir(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), end_id=0, capacity=2048)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: host, path and verdict of each rule
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


#: shares of the expected tokens
TARGETS = {"good": 0.85, "plain": 0.15, "toxic": 0.0}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains of the labelled documents: toxic, else good or plain by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.col("item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(word_runs(with_repeats(table(spark, sf_dir, "documents")), least_length=6, least_exponent=4))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_store, op3_language, op4_digest, op5_warc, op6_neighbours, op7_packing, op8_simhash, op9_url_rules, op10_mixing, op11_decontamination, op12_clusters, op13_runs)}

def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of k-means one after another: s<n> has the sums of round n, c<n> its centroids."""
    near = """SELECT vec_id, cid AS cluster, d AS distance FROM (
            SELECT v.vec_id, c.cid, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
                   row_number() OVER (PARTITION BY v.vec_id ORDER BY list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cid) AS place
            FROM v, {c} c) WHERE place = 1"""
    sql = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
                 WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cid, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    for r in range(rounds):
        sql += f""",
        a{r} AS MATERIALIZED ({near.format(c=f"c{r}")}),
        s{r} AS (SELECT cluster, i, sum(x[i])::HUGEINT AS total, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (vec_id), range(1, 65) t(i) GROUP BY ALL),
        m{r} AS (SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM s{r} GROUP BY cluster),
        c{r + 1} AS MATERIALIZED (SELECT cid, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON cid = cluster)"""
    return sql + f""",
        f AS MATERIALIZED ({near.format(c=f"c{rounds}")})
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
        FROM f JOIN c{rounds} ON cid = cluster"""


ORACLES: dict[str, str] = {
    "op12_clusters": _clusters_sql(),
    "op11_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
             i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
             iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win FROM i, range(1, greatest(len(w) - 8, 2)) t(p) WHERE len(w) > 0),
             dw AS (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM iw), range(1, greatest(len(w) - m + 2, 1)) t(p)),
             h AS (SELECT DISTINCT r, p, iw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
             n AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT r, p, m FROM h), range(0, m) t(k) GROUP BY r),
             s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op9_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
             h AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
             r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
                   FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1""",
}
