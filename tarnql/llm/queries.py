"""The registered queries of this subpackage: thin wrappers that derive the agreed columns from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, cross_polytope, mixing, personal_data, pieces, sharding, simhash, substring_index, topk_search, url_rules
from ._shared import table

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op1_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k_inner(table(spark, sf_dir, "embeddings"), k=5, scale=256.0)


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(docs, model).select("doc_id", "p_content", "p_metadata", "p_quality", "keep")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest_cosine(table(spark, sf_dir, "embeddings"), k=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, check="round_trip").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op5_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_index.dedup_substrings(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (
        op1_topk_segments, op2_cotraining, op3_cross_polytope, op4_sentencepiece, op5_substring_index,
        op6_simhash_neardup, op7_histogram_sharding, op8_url_rules, op9_source_mixing, op10_skip_chain_crf, pipeline,
    )
    return {f.__name__: f for f in ops}


_HOST = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(rule, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
h AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict,
  row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(u.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h WHERE k = 1
"""

#: The sources' caps are found as in water filling: capped sources come first in the order of size by weight.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(level) FILTER (ratio > level AND ratio = (SELECT min(ratio) FROM l WHERE ratio > level)) AS level FROM l),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL OR l.ratio <= f.level THEN l.cap ELSE f.level * l.w END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS full_ FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.full_, e.target - e.full_ * e.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS end_
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (full_ + CASE WHEN rest > 0 AND abs(end_ - rest) < abs(end_ - size - rest) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT win.doc_id, win.i + k AS p FROM win JOIN f USING (g), range(0, 13) t(k) WHERE f.m < win.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_segments": OP1_SQL, "op5_substring_index": OP5_SQL, "op8_url_rules": OP8_SQL, "op9_source_mixing": OP9_SQL}
