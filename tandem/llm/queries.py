"""The llm queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, clustering, exact_search, html_text, line_dedup, lm, near_dedup, near_search, packing, sharding, token_counts, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


OP1_SQL = r"""
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM line),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY p) AS upto
  FROM worded WHERE words > 0),
run AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.i),
content AS (
  SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM run r JOIN placed l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY ALL),
later AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS copy FROM content),
gone AS (SELECT DISTINCT l.doc_id, l.p FROM later r JOIN placed l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e WHERE r.copy > 1),
kept AS (SELECT line.doc_id, string_agg(line.line, chr(10) ORDER BY line.p) AS text FROM line ANTI JOIN gone USING (doc_id, p) GROUP BY line.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.in_fold(F.col("doc_id"), 0)))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.in_fold(F.col("doc_id"), 0).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), toxicity.in_fold(F.col("doc_id"), 1))


def _hundredth(vec_id):
    return vec_id % 100 == 0


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), _hundredth)


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_search.search(table(spark, sf_dir, "embeddings"), _hundredth)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


OP12_ROUND = """,
m{r} AS MATERIALIZED (SELECT v.vec_id, v.x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.c) AS m FROM v, c{r} c GROUP BY v.n, v.vec_id, v.x)"""
OP12_MEANS = """,
s{r} AS (SELECT m % 64 AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM m{r}, range(1, 65) t(i) GROUP BY ALL),
f{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),
c{q} AS MATERIALIZED (SELECT c.c, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{r} f USING (c))"""
OP12_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 40))"""
    + "".join(OP12_ROUND.format(r=r) + OP12_MEANS.format(r=r, q=r + 1) for r in range(5))
    + OP12_ROUND.format(r=5)
    + """
SELECT vec_id, (m % 64)::INTEGER AS cluster, m // 64 AS distance, sum(m // 64) OVER (PARTITION BY m % 64)::BIGINT AS cluster_inertia,
  sum(m // 64) OVER ()::BIGINT AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM m5 JOIN c5 ON c5.c = m % 64
"""
)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_sharding": op2_sharding, "op3_near_dedup": op3_near_dedup, "op4_bpe": op4_bpe, "op5_toxicity": op5_toxicity, "op6_html_text": op6_html_text, "op7_packing": op7_packing, "op8_lm": op8_lm, "op9_exact_search": op9_exact_search, "op10_near_search": op10_near_search, "op11_whitening": op11_whitening, "op12_clustering": op12_clustering, "op13_token_counts": op13_token_counts}


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    """DuckDB SQL by query name."""
    return {"op1_line_dedup": OP1_SQL, "op9_exact_search": OP9_SQL, "op12_clustering": OP12_SQL}
