"""The queries opN_<name> and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, html_layout, inner_products, lexical_search, license_scan, media_columns, mixing, near_dedup, quality, toxicity, url_filter, web_archive
from .tables import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """Rows whose labels no model learns from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, quality.graded_labels(_table(spark, sf_dir, "labels")), train=~held_out())
    return quality.score_quality(docs, model)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_media(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_text(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.cyclic_weights(docs, [5, 2, 1]), share=1.5, max_epochs=2.0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc"
    web_archive.write_archive(_table(spark, sf_dir, "pages"), folder, least=100)
    archive = web_archive.verified_records(spark, folder)
    return archive.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), train=~held_out())
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    paragraphs = license_scan.license_paragraphs(docs)
    model = license_scan.fit_licenses(license_scan.foreign_paragraphs(paragraphs))
    return license_scan.scan_licenses(docs, model, paragraphs=paragraphs)


#: verdict and rule of op10_urls.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document its url ends in: bad if it is poor or toxic."""
    pages = _table(spark, sf_dir, "pages")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    number = F.regexp_extract(url_filter.url_path(F.col("url")), r"/([0-9]{1,18})$", 1)
    outcomes = pages.select(url_filter.url_host(F.col("url")).alias("host"), F.when(number != "", number).cast("long").alias("doc_id")).join(labels, "doc_id")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part="lang")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_inner_products(_table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 50 == 0, k=5)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_media": op4_media,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_urls": op10_urls,
    "op11_search": op11_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_top_k": op13_top_k,
}

_SETS = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM words)"""

ORACLE = {
    "op2_near_dedup": rf"""
WITH RECURSIVE {_SETS},
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN comp ON comp.node = sets.doc_id""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|0') AS k FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
caps AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM totals),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS n,
    (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, n) FROM levels WHERE level <= ratio)), cap) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size AS goal,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(greatest(goal - before, 0), size) AS BIGINT) AS taken FROM ordered""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM r""",
    "op10_urls": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
named AS (
  SELECT *, CASE WHEN last_two IN (__SUFFIXES__) THEN last_two ELSE split_part(host, '.', -1) END AS last,
    CASE WHEN last_two IN (__SUFFIXES__) AND host <> last_two THEN split_part(host, '.', -3) || '.' || last_two ELSE last_two END AS two,
    try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})$', 1), '') AS BIGINT) AS doc_id
  FROM (SELECT *, CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS last_two FROM seen)),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT host, two AS domain, last AS suffix, sum(bad) AS k, count(*) AS n FROM named JOIN flags USING (doc_id)
  WHERE bad IS NOT NULL AND host <> '' GROUP BY ALL),
base AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS mu FROM outcomes),
s0 AS (SELECT suffix, sum(k) AS k, sum(n) AS n, (SELECT mu FROM base) AS prior FROM outcomes GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 0.005), 0.5) - 1 AS m FROM s0),
s AS (SELECT suffix, m + n AS strength, (k + m * prior) / (m + n) AS mean FROM s0, s1),
d0 AS (SELECT domain, o.suffix, sum(k) AS k, sum(n) AS n, any_value(s.mean) AS prior FROM outcomes o JOIN s ON o.suffix = s.suffix GROUP BY domain, o.suffix),
d1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 0.005), 0.5) - 1 AS m FROM d0),
d AS (SELECT domain, m + n AS strength, (k + m * prior) / (m + n) AS mean FROM d0, d1),
h0 AS (SELECT host, k, n, d.mean AS prior FROM outcomes o JOIN d ON o.domain = d.domain),
h1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 0.005), 0.5) - 1 AS m FROM h0),
h AS (SELECT host, m + n AS strength, (k + m * prior) / (m + n) AS mean FROM h0, h1),
bounds AS (
  SELECT n.page_id, n.host, n.path, coalesce(h.mean - sqrt(h.mean * (1 - h.mean) / (h.strength + 1)), d.mean - sqrt(d.mean * (1 - d.mean) / (d.strength + 1)),
    s.mean - sqrt(s.mean * (1 - s.mean) / (s.strength + 1))) AS bound
  FROM named n LEFT JOIN h ON n.host = h.host LEFT JOIN d ON n.two = d.domain LEFT JOIN s ON n.last = s.suffix),
ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM bounds)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op11_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
size AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY t, docs),
q AS (
  SELECT item_id, t, count(*) AS c FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(c * df.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t, size GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a JOIN x b ON b.f <> a.f JOIN x c ON c.f NOT IN (a.f, b.f)
  JOIN x d ON d.f NOT IN (a.f, b.f, c.f) JOIN x e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS f, left(filter_order, s - 1) AS before FROM orders, LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
seen AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failing, len(list_filter(string_split(before, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM cells, steps),
out AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM out""",
    "op13_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}
ORACLE["op10_urls"] = ORACLE["op10_urls"].replace("__SUFFIXES__", ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES))
