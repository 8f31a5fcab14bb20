"""Queries of label resolution, curation by siblings, modalities, density clusters, embeddings and refreshed groups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as ca
from ..operators import describe as de
from ..operators import distributions as ds
from ..operators import embeddings as em
from ..operators import grids
from ..operators import labels as lb
from ..operators import normalize as nm
from ..operators import resample
from ..registry import query
from ..session import read_table, scratch_path
from ..sources import snapshots, views
from ..streaming import health, refresh
from .catalog import X, rounded

#: Raw labels by the size of a part.
RECORD_COLUMNS = [
    "CASE p_size % 8 WHEN 0 THEN 'Tumor' WHEN 1 THEN 'renal tissue' WHEN 2 THEN 'LIVER' WHEN 3 THEN 'lung biopsy' WHEN 4 THEN 'hippocampus' WHEN 5 THEN p_name WHEN 6 THEN 'gastric sample' END AS Tissue",
    "CASE p_size % 5 WHEN 0 THEN 'healthy controls' WHEN 1 THEN 'no disease seen' WHEN 2 THEN p_type WHEN 3 THEN 'sole' ELSE '' END AS Condition",
    "CASE p_size % 4 WHEN 0 THEN 'paclitaxel 10 nM' WHEN 1 THEN 'vehicle; ' || p_type WHEN 2 THEN p_name || ' + aspirin' ELSE 'Not Specified' END AS Treatment",
]
RECORDS = f"r AS (SELECT p_partkey, p_brand AS grp, {', '.join(RECORD_COLUMNS)} FROM part)"
VOCABULARY = [("Tissue", "liver", "D5", "Liver"), ("Tissue", "Kidney", "D1", "Kidney"), ("Treatment", "Paclitaxel", "D20", "Paclitaxel"), ("Tissue", "stomach", "D21", "Stomach")]
HISTORY = [("Tissue", "Hippocampus", "D3", "Hippocampus", "x", 1), ("Treatment", "vehicle", "D40", "Vehicle", "x", 1)]
CANDIDATES = [("Condition", "sole", "D32", "Sole Disease", 0.1)]


def known(spark) -> ca.Knowledge:
    sibling = [("Brand#1", "Tissue", "lung", "D2", "Lung", 3)]
    make = spark.createDataFrame
    return ca.Knowledge(
        siblings=make(sibling, "grp string, col string, raw string, id string, name string, n_uses long"),
        history=make(HISTORY, "col string, label string, id string, name string, source string, at long"),
        vocabulary=make(VOCABULARY, "col string, term string, id string, name string"),
        candidates=make(CANDIDATES, "col string, label string, id string, name string, score double"),
    )


def _rule(column: str) -> str:
    """What SQL knows of a label by what it is."""
    return f"""CASE {column} WHEN 'Tumor' THEN ['', 'Not Specified', 'placeholder'] WHEN 'renal tissue' THEN ['D1', 'Kidney', 'candidates'] WHEN 'LIVER' THEN ['D5', 'Liver', 'vocabulary']
      WHEN 'hippocampus' THEN ['D3', 'Hippocampus', 'history'] WHEN 'gastric sample' THEN ['D21', 'Stomach', 'candidates'] WHEN 'healthy controls' THEN ['', 'Healthy Control', 'control']
      WHEN 'no disease seen' THEN ['', 'Not Specified', 'negation'] WHEN 'sole' THEN ['D32', 'Sole Disease', 'candidates'] WHEN 'paclitaxel 10 nM' THEN ['D20', 'Paclitaxel', 'dose_stripped']
      WHEN 'vehicle' THEN ['D40', 'Vehicle', 'history'] END"""


RESOLVED = f"""{RECORDS}, s AS (SELECT p_partkey, grp, 'Tissue' AS col, Tissue AS raw FROM r UNION ALL SELECT p_partkey, grp, 'Condition', Condition FROM r UNION ALL SELECT p_partkey, grp, 'Treatment', Treatment FROM r),
  p AS (SELECT p_partkey, grp, col, i, trim(x) AS label FROM (SELECT p_partkey, grp, col, regexp_split_to_array(coalesce(raw, ''), CASE col WHEN 'Treatment' THEN '\\s\\+\\s|;' ELSE ';' END) AS xs FROM s), unnest(range(1, len(xs) + 1)) AS u(i),
    unnest([xs[i]]) AS w(x)),
  q AS (SELECT *, CASE WHEN grp = 'Brand#1' AND label = 'lung biopsy' THEN ['D2', 'Lung', 'group_morphology'] ELSE {_rule("label")} END AS a FROM p WHERE label <> '' AND lower(label) <> 'not specified'),
  m AS (SELECT col, lower(label) AS low, min(label) AS name, row_number() OVER (PARTITION BY col ORDER BY lower(label)) AS k FROM q WHERE a IS NULL GROUP BY 1, 2),
  f AS (SELECT q.*, coalesce(a[1], 'ART-' || upper(left(q.col, 2)) || '-' || printf('%05d', k)) AS id, coalesce(a[2], m.name) AS named, coalesce(a[3], 'new') AS source FROM q LEFT JOIN m ON a IS NULL AND m.col = q.col AND m.low = lower(q.label))"""


@query(f"WITH {RESOLVED} SELECT DISTINCT grp, col, label, id, named AS name, source FROM f")
def resolved_labels(spark, d):
    """Every label of every record, and the tier that answered it."""
    parts = read_table(spark, d, "part").selectExpr("p_brand as grp", *RECORD_COLUMNS)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("raw")) for c in ca.COLUMNS])).alias("p")
    split = F.when(F.col("p.col") == "Treatment", lb.split_composite(F.col("p.raw"), plus=True)).otherwise(lb.split_composite(F.col("p.raw")))
    return ca.resolve(parts.select("grp", cells).select("grp", "p.col", F.explode(split).alias("label")), known(spark))


@query(f"""WITH {RESOLVED}, w AS (SELECT p_partkey, col, string_agg(named, '; ' ORDER BY i) AS name, string_agg(id, '; ' ORDER BY i) AS id, string_agg(source, '; ' ORDER BY i) AS source FROM f GROUP BY 1, 2)
  SELECT r.p_partkey, {", ".join(f"coalesce({c[:2]}.name, 'Not Specified') AS {c}, coalesce({c[:2]}.id, '') AS {c}_id, coalesce({c[:2]}.source, '') AS {c}_source" for c in ca.COLUMNS)}
  FROM r {" ".join(f"LEFT JOIN w {c[:2]} ON {c[:2]}.p_partkey = r.p_partkey AND {c[:2]}.col = '{c}'" for c in ca.COLUMNS)}""")
def resolved_records(spark, d):
    return ca.resolve_records(read_table(spark, d, "part").selectExpr("p_partkey", "p_brand as grp", *RECORD_COLUMNS), "p_partkey", "grp", known(spark))


CURATED = """s AS (SELECT p_partkey, p_brand || p_type AS grp, CASE WHEN p_size % 17 = 0 THEN p_name WHEN p_size % 23 = 0 THEN 'Size: ' || p_size WHEN p_size % 19 = 0 THEN 'ghost' ELSE 'Not Specified' END AS label,
    'name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(9) || 'size: ' || p_size ELSE '' END AS blob, CASE WHEN p_size % 2 = 0 THEN ['name', 'size'] ELSE ['name'] END AS fields FROM part WHERE p_type <> 'PROMO'
  UNION ALL SELECT p_partkey, p_brand || p_type, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'LUNG' ELSE 'lung' END, 'lung tissue', CASE WHEN p_size % 20 = 0 THEN ['x'] ELSE ['y'] END FROM part WHERE p_type = 'PROMO')"""


@query(f"""WITH {CURATED}, m AS (SELECT *, label IS NULL OR lower(label) = 'not specified' AS mis FROM s), t AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (mis) OVER g AS nm, count(*) OVER (PARTITION BY grp, fields) AS n_twins FROM m WINDOW g AS (PARTITION BY grp)),
  v AS (SELECT grp, lower(label) AS low, label, count(*) AS c FROM m WHERE NOT mis GROUP BY ALL), w AS (SELECT grp, low, sum(c) AS c, arg_min(label, (-c, label)) AS v FROM v GROUP BY 1, 2),
  o AS (SELECT grp, max(c) AS top_n, arg_min(v, (-c, low)) AS top FROM w GROUP BY 1),
  d AS (SELECT t.*, top, coalesce(top_n, 0) / n AS common, nm / n AS silent, NOT mis AND regexp_matches(label, '^[A-Za-z][\\w.]*\\s*:\\s*\\S+') AND (contains(trim(regexp_replace(lower(blob), '[\\s;,|/\\\\]+', ' ', 'g')), lower(label)) OR contains(lower(blob), lower(label))) AS leak,
    n >= 3 AND NOT mis AND nm / n >= 0.8 AND NOT contains(lower(blob), lower(label)) AS dem, n >= 3 AND mis AND coalesce(top_n, 0) / n >= 0.8 AS pro, CASE WHEN mis THEN 'Not Specified' ELSE label END AS kept FROM t LEFT JOIN o USING (grp))
  SELECT p_partkey, CASE WHEN leak THEN 'Not Specified' WHEN (dem OR pro) AND n_twins < 3 THEN kept WHEN dem THEN 'Not Specified' WHEN pro THEN top ELSE kept END AS final_value,
  CASE WHEN leak THEN 'demote' WHEN (dem OR pro) AND n_twins < 3 THEN 'flag_only' WHEN dem THEN 'demote' WHEN pro THEN 'promote' ELSE 'keep' END AS action,
  CASE WHEN leak THEN 'key_value_leak' WHEN dem THEN 'siblings_silent' WHEN pro THEN 'siblings_agree' WHEN n < 3 THEN 'few_siblings' ELSE 'no_consensus' END AS reason,
  round(CASE WHEN leak THEN 1.0 WHEN dem THEN silent WHEN pro THEN common WHEN n < 3 THEN 0.0 ELSE greatest(silent, common) END, 6) AS support, n_twins FROM d""")
def curated_labels(spark, d):
    part = read_table(spark, d, "part")
    one = part.where("p_type <> 'PROMO'").selectExpr(
        "p_partkey", "p_brand || p_type AS grp", "CASE WHEN p_size % 17 = 0 THEN p_name WHEN p_size % 23 = 0 THEN 'Size: ' || p_size WHEN p_size % 19 = 0 THEN 'ghost' ELSE 'Not Specified' END AS label",
        "'name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN '\\tsize: ' || p_size ELSE '' END AS blob", "CASE WHEN p_size % 2 = 0 THEN array('name', 'size') ELSE array('name') END AS fields",
    )
    other = part.where("p_type = 'PROMO'").selectExpr("p_partkey", "p_brand || p_type AS grp", "CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'LUNG' ELSE 'lung' END AS label", "'lung tissue' AS blob", "CASE WHEN p_size % 20 = 0 THEN array('x') ELSE array('y') END AS fields")
    found = lb.curate(one.unionByName(other), ["grp"], "label", "blob", "fields")
    return rounded(found.select("p_partkey", "final_value", "action", "reason", "support", "n_twins"))


def harmonized(spark, d):
    return nm.harmonize(views.expression(spark, d).where("value is not null"))


KOLMOGOROV = "CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * (k * x) * (k * x)))))) END"


@query(f"""{X}, h AS (SELECT platform, gene, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS v FROM expr WHERE value IS NOT NULL WINDOW w AS (PARTITION BY platform, gene)),
  k AS (SELECT a.platform AS a, b.platform AS b FROM (SELECT DISTINCT platform FROM h) a JOIN (SELECT DISTINCT platform FROM h) b ON a.platform < b.platform),
  j AS (SELECT gene, a, b, v, count(*) FILTER (platform = a) AS c1, count(*) FILTER (platform = b) AS c0 FROM h JOIN k ON platform IN (a, b) GROUP BY ALL),
  n AS (SELECT *, sum(c1) OVER (PARTITION BY gene, a, b) AS n1, sum(c0) OVER (PARTITION BY gene, a, b) AS n0, sum(c1) OVER w AS s1, sum(c0) OVER w AS s0 FROM j WINDOW w AS (PARTITION BY gene, a, b ORDER BY v)),
  t AS (SELECT gene, a, b, n1::BIGINT AS n1, n0::BIGINT AS n0, max(abs(s1 / n1 - s0 / n0)) AS ks FROM n GROUP BY ALL HAVING n1 > 1 AND n0 > 1), p AS (SELECT *, sqrt(n1 * n0 / (n1 + n0)) * ks AS x FROM t),
  q AS (SELECT gene, a, b, n1, n0, ks, {KOLMOGOROV} AS p FROM p)
  SELECT gene, a, b, n1, n0, round(ks, 6) AS ks, round(p, 6) AS p_value, CASE WHEN p >= 0.05 THEN 'same shape' ELSE 'differs' END AS verdict FROM q""")
def modality_verdicts(spark, d):
    return rounded(de.modality_verdicts(harmonized(spark, d), exact=False))


@query()
def modality_concordance(spark, d):
    rows = views.expression(spark, d).where("value is not null")
    each = rows.select(F.concat_ws("|", "platform", "gene").alias("gene"), "value")
    classes = ds.distribution_classes(each).select(F.substring_index("gene", "|", 1).alias("platform"), F.substring_index("gene", "|", -1).alias("gene"), "distribution")
    return de.modality_concordance(rows, classes, de.modality_verdicts(harmonized(spark, d)))


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal / 400 AS y FROM customer), n AS (SELECT a.id, b.id AS o, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS g
    FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.2 * 1.2), k AS (SELECT id FROM n GROUP BY 1 HAVING count(*) >= 4),
  e AS (SELECT n.id, n.o FROM n JOIN k USING (id) JOIN k k2 ON k2.id = n.o), reach AS (SELECT id, id AS r FROM k UNION SELECT reach.id, e.o FROM reach JOIN e ON e.id = reach.r),
  root AS (SELECT id, min(r) AS root FROM reach GROUP BY 1), num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM root)), lab AS (SELECT id, c FROM root JOIN num USING (root)),
  bord AS (SELECT n.id, arg_min(lab.c, (n.g, n.o)) AS c FROM n JOIN lab ON lab.id = n.o WHERE n.id NOT IN (SELECT id FROM k) GROUP BY 1)
  SELECT p.id AS c_custkey, coalesce(lab.c, bord.c, -1)::BIGINT AS cluster, lab.c IS NOT NULL AS is_core FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN bord ON bord.id = p.id""")
def density_clusters(spark, d):
    rows = read_table(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 400).alias("v"))
    return grids.dbscan(rows, "c_custkey", "v", 1.2, 4)


@query()
def cell_coordinates(spark, d):
    """The first components of suppliers by brands, as magnitudes."""
    found = em.truncated_svd(views.counts(spark, d), "sample_id", "gene", "count", k=5)
    return rounded(found.scores.select("sample_id", F.transform("scores", F.abs).alias("s")).select("sample_id", *[F.col("s")[i].alias(f"c{i + 1}") for i in range(2)]), 4)


@query()
def batch_free_coordinates(spark, d):
    """Embeddings with the three platforms laid over each other."""
    rows = read_table(spark, d, "embeddings").withColumn("platform", F.expr("concat('P', vec_id % 3)"))
    found = em.harmony(rows, "vec_id", "embedding", "platform", clusters=10, rounds=3)
    return rounded(found.select("vec_id", "platform", F.aggregate("corrected", F.lit(0.0), lambda a, x: a + x * x).alias("square")), 4)


@query()
def bootstrap_medians(spark, d):
    return rounded(resample.bootstrap(views.cells(spark, d), ["cell_type"], "cell_id", "median", replicates=1000))


@query("""WITH n AS (SELECT source, coalesce(lang, 'Not Specified') AS v, count(*) AS n FROM documents GROUP BY 1, 2)
  SELECT source, sum(n)::BIGINT AS n_total, coalesce(sum(n) FILTER (v = 'Not Specified'), 0)::BIGINT AS n_missing, coalesce(string_agg(v || '=' || n, ',' ORDER BY v) FILTER (v <> 'Not Specified'), '') AS value_dist FROM n GROUP BY 1""")
def refreshed_groups(spark, d):
    """Languages of sources after three batches, each of which refreshes the sources that it touches; the second repeats the first's rows."""
    docs = read_table(spark, d, "documents").select("source", "doc_id", "lang", F.lit(1).cast("long").alias("at"))
    kept = refresh.GroupRefresher(spark, scratch_path(spark, "refreshed"), "source string, doc_id long, lang string, at long", ["source"], ["doc_id"], "at", refresh.value_counts(["source"], "lang"), parts=8)
    for batch in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 0 or doc_id % 3 = 0"), docs.where("coalesce(doc_id % 2, 1) <> 0")):
        kept.refresh(batch)
    entries = F.transform(F.array_sort(F.map_entries("value_dist")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return kept.current().select("source", "n_total", "n_missing", F.array_join(entries, ",").alias("value_dist"))


@query("""WITH k AS (SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'Condition' ELSE 'Tissue' END AS col, CASE n_nationkey % 10 WHEN 0 THEN 'Wild Type' ELSE n_name END AS label FROM nation),
  f AS (SELECT * FROM k WHERE NOT (col = 'Condition' AND lower(label) = 'wild type')), s AS (SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END AS cluster_id,
    CASE c_custkey % 3 WHEN 0 THEN lower(label) WHEN 1 THEN label ELSE label || ' of old' END AS synonym FROM customer JOIN k ON c_nationkey = id)
  SELECT c_custkey, cluster_id, synonym FROM s JOIN f ON cluster_id = id AND lower(synonym) = lower(label)""")
def repaired_synonyms(spark, d):
    nation = read_table(spark, d, "nation")
    clusters = nation.selectExpr("n_nationkey AS id", "CASE n_regionkey WHEN 0 THEN 'Condition' ELSE 'Tissue' END AS col", "CASE n_nationkey % 10 WHEN 0 THEN 'Wild Type' ELSE n_name END AS label")
    named = read_table(spark, d, "customer").join(clusters, F.col("c_nationkey") == F.col("id"))
    synonyms = named.selectExpr("c_custkey", "c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END AS cluster_id", "CASE c_custkey % 3 WHEN 0 THEN lower(label) WHEN 1 THEN label ELSE label || ' of old' END AS synonym")
    return snapshots.repaired_vocabulary(clusters, synonyms)[1]


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang IS NULL) AS n_unknown FROM documents GROUP BY 1""")
def guarded_documents(spark, d):
    """Documents by source, after a stage that would stop if more than a quarter of them had no text."""
    fine = health.guarded(read_table(spark, d, "documents").select("source", "lang", F.length("text").alias("n")), F.col("n").isNull(), "lengths")
    return fine.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("n_unknown"))
