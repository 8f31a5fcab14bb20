"""Queries of platform annotation, regions, contrasts and label checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import regions as rg
from ..operators import search as se
from ..registry import query
from ..session import read_table
from ..sources import platform as pf
from ..sources import views
from ..sources.views import EXPRESSION_SQL
from .catalog import rounded

STOP_SQL = ", ".join(f"'{w}'" for w in rg.STOP_WORDS)


@query("""SELECT DISTINCT p_partkey::VARCHAR AS probe_id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS gene FROM part WHERE p_size % 5 <> 0""")
def probe_annotation(spark, d):
    """Symbols written as ``a /// b``, bare, or as a dash, which names no gene."""
    p = read_table(spark, d, "part")
    text = F.when(F.col("p_size") % 5 == 0, " --- ").when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" /// "), "p_brand")).otherwise(F.col("p_brand"))
    return pf.annotation(p.select(F.col("p_name").alias("GB_ACC"), text.alias("Gene Symbol"), F.col("p_partkey").alias("ID")))


@query("""WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
  o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
  SELECT s.o_custkey AS sample_id, c_name AS title, c_mktsegment AS label, o_orderstatus AS status, o_totalprice AS price FROM s
  LEFT JOIN customer ON s.o_custkey = c_custkey LEFT JOIN o ON s.o_custkey = o.o_custkey AND r = 1""")
def region_table(spark, d):
    orders, customer = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    meta = customer.select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("label"))
    own = orders.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("label"),
                        F.struct("o_orderdate", "o_orderkey").alias("at"))
    region = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("sample_id"))
    return rg.assemble(region, "sample_id", (meta, ["title"]), (own, ["at"])).drop("at")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'o_orderstatus=F AND o_orderpriority=1-URGENT' ELSE 'Other' END AS label_group
  FROM orders""")
def compound_label_groups(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", rg.compound_group({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).alias("label_group"))


@query("""WITH r AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1)
  SELECT max(v) FILTER (r = 1) AS "case", max(v) FILTER (r = 2) AS control FROM r""")
def default_contrast_of_segments(spark, d):
    return rg.default_contrast(read_table(spark, d, "customer"), "c_mktsegment")


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS denied FROM orders""")
def denied_fields(spark, d):
    """Texts such as ``relapse status = none``, ``smoker: NO`` and, not denied, ``status: P``."""
    o = read_table(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "F", "relapse status = none ").when(F.col("o_orderstatus") == "O", " smoker: NO").otherwise(F.concat(F.lit("status: "), "o_orderstatus"))
    return o.select("o_orderkey", F.coalesce(rg.is_denied(text), F.lit(False)).alias("denied"))


@query("""SELECT p_partkey, p_name AS gene_name, p_type AS kind, '' AS missing FROM part""")
def marked_answers(spark, d):
    text = F.concat(F.lit("[[ ## name ## ]]\n"), "p_name", F.lit("\n[[## kind ##]] "), "p_type", F.lit("\n\n[[ ## completed ## ]]"))
    return read_table(spark, d, "part").select("p_partkey", rg.marked_section(text, "name").alias("gene_name"), rg.marked_section(text, "kind").alias("kind"),
                                               rg.marked_section(text, "other").alias("missing"))


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size / 50 AS sim, split_part(p_name, ' ', 2) || ' ' || lower(p_type) AS cand,
  list_distinct(string_split(p_name, ' ')) AS q FROM part), l AS (SELECT *, list_distinct(string_split(cand, ' ')) AS c FROM w),
  s AS (SELECT *, len(list_intersect(q, c)) AS hits FROM l),
  t AS (SELECT p_brand, p_partkey, cand, round(5 * sim + 10 * hits - 3 * (len(c) - hits) + CASE WHEN len(c) <= len(q) THEN 5 ELSE 0 END, 3) AS score FROM s)
  SELECT p_brand, cand, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, cand) AS rank FROM t""")
def ranked_candidates(spark, d):
    p = read_table(spark, d, "part")
    rows = p.select("p_brand", "p_name", F.concat_ws(" ", F.split("p_name", " ")[1], F.lower("p_type")).alias("cand"), (F.col("p_size") / 50).alias("sim"))
    return rg.rank_candidates(rows, ["p_brand"], "p_name", "cand", "sim").select("p_brand", "cand", "score", "rank")


@query(f"""WITH v AS (SELECT p_brand AS series, CASE p_size % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN 'the ' || upper(p_name) WHEN 2 THEN p_name || ' 24' ELSE p_name END AS label FROM part),
  n AS (SELECT series, label, count(*) AS n FROM v GROUP BY ALL),
  k AS (SELECT *, list_filter(regexp_extract_all(lower(label), '[a-z][a-z0-9-]*'), lambda x: x NOT IN ({STOP_SQL})) AS toks,
    list_sort(list_distinct(regexp_extract_all(label, '[0-9]+'))) AS digits FROM n),
  s AS (SELECT *, list_distinct(list_transform(toks, lambda x: CASE WHEN x LIKE '%ers' OR x LIKE '%ing' THEN x[:-4] WHEN x LIKE '%er' THEN x[:-3]
    WHEN x LIKE '%s' AND len(x) > 3 THEN x[:-2] ELSE x END)) AS stems FROM k),
  e AS (SELECT series, stem FROM (SELECT series, unnest(stems) AS stem FROM s) JOIN (SELECT series, count(*) AS t FROM s GROUP BY 1) USING (series)
    GROUP BY series, stem, t HAVING count(*) / t >= 0.7), g AS (SELECT series, list(stem) AS shared FROM e GROUP BY 1),
  f AS (SELECT series, label, n, digits, list_sort(list_filter(stems, lambda x: NOT list_contains(coalesce(shared, []), x))) AS told FROM s LEFT JOIN g USING (series))
  SELECT series, label, n, first_value(label) OVER (PARTITION BY series, told, digits ORDER BY n DESC, len(label), label) AS canonical FROM f""")
def converged_labels(spark, d):
    """Plural, capital and numbered spellings of a part's name within its brand: the numbered ones stay apart."""
    name, kind = F.col("p_name"), F.col("p_size") % 4
    label = F.when(kind == 0, F.concat(name, F.lit("s"))).when(kind == 1, F.concat(F.lit("the "), F.upper(name))).when(kind == 2, F.concat(name, F.lit(" 24"))).otherwise(name)
    return rg.converge(read_table(spark, d, "part").select(F.col("p_brand").alias("series"), label.alias("label")), "series", "label")


@query("""SELECT o_orderkey::VARCHAR AS gsm, o_orderstatus AS current, c_mktsegment AS suggest, '' AS quote FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def accepted_proposals(spark, d):
    """The source holds the suggestion with other white space, but for orders of status O."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    text = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("segment:\t\n"), "c_mktsegment")).otherwise("nothing")
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("gsm"), F.col("o_orderstatus").alias("current"), F.concat(F.lit(" "), "c_mktsegment").alias("suggest"),
        F.lit(None).cast("string").alias("quote"), text.alias("source"),
    )
    return rg.valid_proposals(p, read_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("gsm")))


@query(f"""WITH {EXPRESSION_SQL}, m AS (SELECT gene AS source, avg(value) AS m FROM expr GROUP BY 1 HAVING count(value) > 0)
  SELECT source, round(m, 6) AS mean_activity, round(abs(m), 6) AS abs_activity FROM m ORDER BY abs(m) DESC, source LIMIT 15""")
def top_activities(spark, d):
    return rounded(rg.activity_ranking(views.expression(spark, d).select(F.col("gene").alias("source"), "value"), "source", 15))


@query("""SELECT event_id AS cell_id, event_type AS cell_type FROM events ORDER BY md5(event_id::VARCHAR || ':42'), event_id LIMIT 500""")
def capped_cells(spark, d):
    """A sampling operator: 500 cells by seeded hash."""
    return rg.capped(views.cells(spark, d), "cell_id", 500, 42).select("cell_id", "cell_type")


@query("""SELECT DISTINCT 'GPL' || n_nationkey AS gpl, n_name AS title, 'GSE' || c_custkey AS gse FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey = 3""")
def series_of_platform(spark, d):
    return rg.platform_series(views.metadata(spark, d), "gpl3")


@query("""SELECT o_orderkey AS gsm, 'GSE' || o_custkey AS series FROM orders""")
def samples_first_series(spark, d):
    o = read_table(spark, d, "orders")
    listed = F.concat(F.lit(" GSE"), "o_custkey", F.lit(" , GSE"), "o_orderkey")
    return o.select(F.col("o_orderkey").alias("gsm"), rg.first_series(listed).alias("series"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN NULL ELSE p_name END AS bare FROM part""")
def dose_free_names(spark, d):
    """Doses in brackets, factors and durations go; a name without any gives null."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    dosed = F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit(" ("), size, F.lit(" nM), 10-fold"))).when(F.col("p_size") % 3 == 1, name)
    return read_table(spark, d, "part").select("p_partkey", lb.strip_dose(dosed.otherwise(F.concat(name, F.lit(" "), size, F.lit(".5 mg/kg for 3 days")))).alias("bare"))


def spelled(spark, d):
    """Names of parts by type in four spellings, by size."""
    name, kind = F.col("p_name"), F.col("p_size") % 4
    label = F.when(kind == 0, F.upper(name)).when(kind == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(kind == 2, F.concat(name, F.lit("."))).otherwise(name)
    return read_table(spark, d, "part").select("p_type", label.alias("label"))


@query("""WITH v AS (SELECT p_type, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || '.' ELSE p_name END AS label FROM part),
  n AS (SELECT p_type, label, count(*) AS n FROM v GROUP BY ALL)
  SELECT p_type, label, n, first_value(label) OVER (PARTITION BY p_type, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') ORDER BY n DESC, label) AS canonical FROM n""")
def collapsed_variants(spark, d):
    """As collapsed_labels, with spellings that have to meet."""
    return lb.collapse(spelled(spark, d), ["p_type"], "label")


@query("""WITH v AS (SELECT p_type, CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS label FROM part), n AS (SELECT p_type, label, count(*) AS n FROM v GROUP BY ALL)
  SELECT s.p_type, s.label, first(b.label ORDER BY b.n DESC, b.label) AS container FROM n s JOIN n b ON s.p_type = b.p_type AND b.label LIKE '% ' || s.label GROUP BY ALL""")
def contained_labels(spark, d):
    label = F.when(F.col("p_size") % 4 == 0, F.split("p_name", " ")[1]).otherwise(F.col("p_name"))
    return se.containment(read_table(spark, d, "part").select("p_type", label.alias("label")), ["p_type"], "label")


@query("""SELECT p_partkey, [p_name, p_brand, p_type] AS parts FROM part""")
def composite_treatments(spark, d):
    text = F.concat("p_name", F.lit(" + "), "p_brand", F.lit(" ; ; "), "p_type")
    return read_table(spark, d, "part").select("p_partkey", lb.split_composite(text, plus=True).alias("parts"))


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_name ILIKE '%economy%' OR p_type ILIKE '%economy%'""")
def rows_with_words(spark, d):
    return read_table(spark, d, "part").where(se.any_contains(["p_name", "p_type"], ["Ring", "economy"])).select("p_partkey")
