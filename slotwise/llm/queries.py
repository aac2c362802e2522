"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontam, html_extract, lang_id, license_scan, line_dedup, lm_score, mixing, near_dup, pii, quality, repair, url_filter, whitening

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_languages(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors, components=4)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode_outer("whitened").alias("at", "whitened")).filter("at is not null")  # outer: else a filter on the list's size is put under the projection, which then runs twice
    shares = [float(e) for e in model.explained] if model else []
    explained = F.element_at(F.array(*map(F.lit, shares)) if shares else F.array(F.lit(None).cast("double")), F.col("at") + 1)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_url_filter, op3_html_extract, op4_near_dup, op5_quality_rules, op6_lm_score, op7_license_scan, op8_decontaminate, op9_language_id, op10_line_dedup, op11_pii, op12_conversation_repair, op13_whitening)
    return {f.__name__: f for f in found}


_OP1_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
pmf AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p, ceil(rate + 12 * sqrt(rate) + 14) AS most FROM r, range(0, 800) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf WHERE k <= most),
lists AS (SELECT source, list(c) AS cdf FROM cdf GROUP BY source),
u AS (SELECT d.*, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents d),
c AS (SELECT u.*, len(list_filter(cdf, lambda x: x < u.u)) AS times FROM u JOIN lists l ON u.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INTEGER AS copy FROM c
"""

_OP2_SQL = (
    "WITH rules(host, path, verdict) AS (VALUES "
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    + r"""),
p AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT p.n, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
"""
)

_OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""


# The CRC of conv_id:turn bit by bit; faults by row; the cheapest edits row by row (z, s, u, a: cost and audit with nothing, a system, user or assistant row before).
_OP12_SQL = r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(key) + 1), lambda j: [unicode(key[j:j])::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, b: xor((CASE WHEN b >= 0 THEN xor(x, b) ELSE x END) >> 1, CASE WHEN (CASE WHEN b >= 0 THEN xor(x, b) ELSE x END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS initial FROM o),
y AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM y GROUP BY 1),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 's': ''} AS z, {'c': 1000000000::BIGINT, 's': ''} AS s, {'c': 1000000000::BIGINT, 's': ''} AS u, {'c': 1000000000::BIGINT, 's': ''} AS a FROM convs
  UNION ALL SELECT conv_id, i, {'c': z.c + 2, 's': z.s || 'D'},
    list_min([{'c': s.c + 2, 's': s.s || 'D'}, {'c': CASE WHEN initial = 's' AND NOT gone THEN z.c + more ELSE 2000000000 END, 's': z.s || 'K'}]),
    list_min([{'c': u.c + 2, 's': u.s || 'D'}] || list_transform([z, s, a], lambda q: {'c': CASE WHEN gone THEN 2000000000 WHEN initial = 'u' THEN q.c + more ELSE q.c + more + 1 END, 's': q.s || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END})),
    list_min([{'c': a.c + 2, 's': a.s || 'D'}, {'c': CASE WHEN gone THEN 2000000000 WHEN initial = 'a' THEN u.c + more ELSE u.c + more + 1 END, 's': u.s || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END}])
  FROM (SELECT conv_id, y.i, z, s, u, list_min([a, {'c': u.c + 5, 's': u.s || 'I'}]) AS a, initial, gone, more
    FROM (SELECT conv_id AS c0, i AS i0, z, s, a, list_min([u] || list_transform([z, s, a], lambda q: {'c': q.c + 5, 's': q.s || 'I'})) AS u FROM dp) JOIN y ON y.conv_id IS NOT DISTINCT FROM c0 AND y.i = i0 + 1)),
e AS (SELECT conv_id, list_min([z, a, {'c': list_min([u] || list_transform([z, s, a], lambda q: {'c': q.c + 5, 's': q.s || 'I'})).c + 5, 's': list_min([u] || list_transform([z, s, a], lambda q: {'c': q.c + 5, 's': q.s || 'I'})).s || 'I'}]) AS best
  FROM dp JOIN (SELECT convs.conv_id AS c1, coalesce(n, 0) AS n FROM convs LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM convs.conv_id) ON c1 IS NOT DISTINCT FROM conv_id AND i = n),
l AS (SELECT conv_id, unnest(range(1, len(best.s) + 1)) AS p, best.s AS audit FROM e),
w AS (SELECT conv_id, p, audit[p:p] AS letter, count(*) FILTER (audit[p:p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
m AS (SELECT w.*, y.role, y.text, y.initial, row_number() OVER (PARTITION BY w.conv_id ORDER BY p) AS place FROM w LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i AND letter <> 'I' WHERE letter <> 'D'),
v AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM m),
r AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM v GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.s AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM e LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1_SQL, "op2_url_filter": _OP2_SQL, "op4_near_dup": _OP4_SQL, "op12_conversation_repair": _OP12_SQL}
