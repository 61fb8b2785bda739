"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmltext, jaccard, langid, license, mixing, quality, sharding, urlfilter, vecdedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in urlfilter.BLOCKED], "key string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), listed)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op5_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.dedup(_table(spark, sf_dir, "embeddings"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), sharding.tree(8), sharding.tree(9))


QUERIES = {
    "op1_url_cascade": op1_url_cascade,
    "op2_source_mix": op2_source_mix,
    "op3_pairwise_quality": op3_pairwise_quality,
    "op4_license_align": op4_license_align,
    "op5_host_consensus": op5_host_consensus,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_sorted_passes": op7_sorted_passes,
    "op8_ppm_language": op8_ppm_language,
    "op9_partition_join": op9_partition_join,
    "op10_hash_tree": op10_hash_tree,
}

_listed = ", ".join(f"('{h}')" for h in urlfilter.BLOCKED)
_rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
_fits = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"

OP1_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
split AS (
  SELECT page_id, translate(raw, '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
listed(name) AS (VALUES {_listed}),
bad AS (
  SELECT DISTINCT host FROM split, listed WHERE host = name OR ends_with(host, '.' || name))
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r[0] + r[1]}'" for r in _rules)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r[2]}'" for r in _rules)}
            WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM split
"""


def _map(table: dict, key: str, default: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


def _fill(name: str, source: str, parent: str) -> str:
    """A level of the tree from the definition: the budget rises like water in the children, each as wide as its weight.

    A child is full if the water that stands as high as its rim, in all its siblings, takes no more than the budget. The
    rest is shared by weight among the others.
    """
    same = " AND ".join(f"b.{c} = a.{c}" for c in parent.split(", ")) if parent else "TRUE"
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_a AS (
  SELECT a.*, a.w > 0 AND (SELECT sum(least(b.cap * a.w, b.w * a.cap)) FROM {source} b WHERE {same}) <= a.budget * a.w AS filled FROM {source} a),
{name} AS (
  SELECT *, CAST(CASE WHEN filled THEN cap WHEN w > 0 THEN
    (w * (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0))) // sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) ELSE 0 END AS BIGINT) AS given FROM {name}_a)"""


def mix_sql(docs: str, domains=mixing.DOMAINS, weights=mixing.WEIGHTS, share=(3, 5), most_epochs=4, seed=17) -> str:
    """The CTEs of mixing.mix over a relation; the last is named mixed."""
    space = r"[ \t\n\x0B\f\r]"
    return f"""
rows_ AS (
  SELECT doc_id, {_map(domains, "coalesce(source, 'unknown')", "'other'")} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM {docs}),
leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {most_epochs} AS cap,
    {_map(weights, "domain || '/' || lang || '/' || source", "1")} AS w FROM rows_ GROUP BY ALL),
langs AS (
  SELECT domain, lang, CAST(coalesce(sum(cap) FILTER (w > 0), 0) AS BIGINT) AS cap, {_map(weights, "domain || '/' || lang", "1")} AS w FROM leaves GROUP BY domain, lang),
d0 AS (
  SELECT domain, CAST(coalesce(sum(cap) FILTER (w > 0), 0) AS BIGINT) AS cap, {_map(weights, "domain", "1")} AS w,
    (CAST((SELECT sum(tokens) FROM leaves) AS BIGINT) * {share[0]}) // {share[1]} AS budget FROM langs GROUP BY domain),
{_fill("d1", "d0", "")},
l0 AS (SELECT langs.*, d1.given AS budget FROM langs JOIN d1 USING (domain)),
{_fill("l1", "l0", "domain")},
s0 AS (SELECT leaves.*, l1.given AS budget FROM leaves JOIN l1 USING (domain, lang)),
{_fill("s1", "s0", "domain, lang")},
plan AS (
  SELECT domain, lang, source, coalesce(given // nullif(tokens, 0), 0) AS epochs, given - coalesce(given // nullif(tokens, 0), 0) * tokens AS rest FROM s1),
keyed AS (
  SELECT rows_.*, epochs, rest, substr(md5('{seed}:' || (epochs + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM rows_ JOIN plan USING (domain, lang, source)),
mixed AS (
  SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs,
    CAST(rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest AS BIGINT) AS partial
  FROM keyed)"""


OP2_SQL = f"WITH {mix_sql('documents')}\nSELECT *, epochs + partial AS copies FROM mixed"

_tokens = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

#: From the definition: every offset at which enough words of an item and a document are equal, not only those that seeds hit.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_tokens("text")} AS t FROM documents), b AS (SELECT item_id, {_tokens("text")} AS t FROM benchmark),
dw AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM d),
bw AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM b WHERE len(t) >= 5),
near AS (SELECT doc_id, item_id, dw.p - bw.p AS off FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= 5),
laid AS (
  SELECT doc_id, item_id, off, len(b.t) AS n, least(12, len(b.t)) AS w, list_transform(range(len(b.t)), lambda i: CASE WHEN i + off >= 0 AND d.t[i + off + 1] = b.t[i + 1] THEN 1 ELSE 0 END) AS same
  FROM near JOIN d USING (doc_id) JOIN b USING (item_id)),
runs AS (SELECT *, list_sum(same) AS matched, list_max(list_transform(range(n - w + 1), lambda s: list_sum(same[s + 1 : s + w]))) AS best FROM laid),
top AS (SELECT doc_id, item_id, n, max({{matched: matched, best: best, off: -off}}) AS m FROM runs WHERE best >= greatest(ceil(w * 0.75), least(6, n)) GROUP BY ALL)
SELECT doc_id, item_id, CAST(m.matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS item_words, CAST(m.best AS INTEGER) AS best, CAST(-m.off AS INTEGER) AS at FROM top
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, min(c) = vec_id AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * c >= 75 * (na + nb - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM reach JOIN s USING (doc_id) GROUP BY doc_id
"""

ORACLE = {
    "op1_url_cascade": OP1_SQL,
    "op2_source_mix": OP2_SQL,
    "op6_spaced_seeds": OP6_SQL,
    "op7_sorted_passes": OP7_SQL,
    "op9_partition_join": OP9_SQL,
}
