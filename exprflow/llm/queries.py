"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, ship
from . import conversations, hardneg, html, langid, licenses, lmscore, mixing, neardup, packing, quality, secrets, tokenfile, topk


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.0, max_epochs=3.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.stupid_backoff(read_table(spark, sf_dir, "documents"))
    return scored.withColumn("score", F.round("score", 6))


def op5_lm_score_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.stupid_backoff(read_table(spark, sf_dir, "documents"), order=3)
    return scored.withColumn("score", F.round("score", 6))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=2048)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read_table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATS[:5], "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), every=50, k_positives=5, k_negatives=3, low=50, high=95, scale=256)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(read_table(spark, sf_dir, "conversations"))
    return conversations.conversation_digests(conversations.repair_conversations(damaged))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    own = (
        op1_mix_sources, op2_language_id, op3_topk_search, op4_near_dedup, op5_lm_score, op5_lm_score_trigrams, op6_pack, op7_html_text,
        op8_token_files, op9_license_scan, op10_quality_rules, op11_hard_negatives, op12_conversation_repair, op13_secret_scan,
    )
    return {q.__name__: _shipped(q) for q in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), o AS (SELECT *, min(CASE WHEN level * weight <= cap THEN {{'r': cap / weight, 'l': level}} END) OVER () AS best FROM l),
t AS (SELECT source, source_size, CASE WHEN best IS NULL THEN cap ELSE least(cap, best.l * weight) END AS target FROM o),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(h, 1, 16), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM p
"""

OP3_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 3], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL, "op3_topk_search": OP3_SQL, "op4_near_dedup": OP4_SQL, "op5_lm_score": lmscore.ORACLE_SQL,
        "op11_hard_negatives": hardneg.ORACLE_SQL, "op12_conversation_repair": conversations.ORACLE_SQL,
    }
