"""The monitoring tables, as views over the tables of a data folder, in Spark and in SQL.

`pages` gives two crawl runs with some pages missing, some new and some changed; `documents` gives
files found on pages; `events` the log of changes; `orders` the jobs; `conversations` the
acquisition attempts; `labels` a reviewer's labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import texts, urls
from pagewake.sources.tables import table


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, page_id, url, html of two runs; the second lacks pages, has others, and has changed some."""
    runs = F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id")
    both = table(spark, sf_dir, "pages").select("page_id", "url", "html", runs).where("(run_id = 1 AND page_id % 7 <> 0) OR (run_id = 2 AND page_id % 5 <> 0)")
    changed = (F.col("run_id") == 2) & (F.col("page_id") % 3 == 0)
    return both.withColumn("html", F.when(changed, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html"))).select("run_id", "page_id", "url", "html")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, run_id, page_id, site, canonical_url, path, content_hash: what a run keeps of a page."""
    u = F.col("url")
    return captures(spark, sf_dir).select(
        (F.col("run_id") * 1_000_000_000 + F.col("page_id")).cast("bigint").alias("id"),
        "run_id",
        "page_id",
        urls.origin(u).alias("site"),
        urls.canonical_url(u).alias("canonical_url"),
        urls.path_of(u).alias("path"),
        F.sha2("html", 256).alias("content_hash"),
    )


def file_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, run_id, page_id, site, download_url, sha256, doc_type of files, spread over all pages."""
    n_pages = table(spark, sf_dir, "pages").select(F.nullif(F.count("*"), F.lit(0))).scalar()
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (1 + F.floor(F.col("doc_id") / 20) % 2).cast("int").alias("run_id"),
        (F.col("doc_id") % n_pages).alias("page_id"),
        F.col("source").alias("site"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/files/"), F.floor(F.col("doc_id") / 40).cast("string"), F.lit(".pdf")).alias("download_url"),
        F.sha2("text", 256).alias("sha256"),
        F.when(F.col("doc_id") % 3 == 0, "docx").otherwise("pdf").alias("doc_type"),
        F.length("text").cast("bigint").alias("file_size"),
    )


def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from, to of the links inside each site: its root leads to its sections, these to their pages, and pages where their anchors point."""
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("url", "html", urls.origin(u).alias("site"), urls.canonical_url(u).alias("page"), urls.path_prefix(urls.path_of(u), 1).alias("section")).where("page <> ''")
    root, section = F.concat("site", F.lit("/")), F.concat("site", "section")
    tree = p.select(F.explode(F.array(F.struct(root.alias("from"), section.alias("to")), F.struct(section.alias("from"), F.col("page").alias("to")))).alias("e")).select("e.*")
    anchors = p.select("site", F.col("page").alias("from"), F.explode(texts.absolute_links(F.col("html"), u)).alias("link"))
    inside = anchors.where(urls.origin(F.col("link")) == F.col("site")).select("from", urls.canonical_url(F.col("link")).alias("to"))
    return tree.unionByName(inside).distinct()


def page_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, node: the root of each site."""
    site = urls.origin(F.col("url"))
    return table(spark, sf_dir, "pages").where(urls.canonical_url(F.col("url")) != "").select(site.alias("scope"), F.concat(site, F.lit("/")).alias("node")).distinct()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, site_id, detected_at, change_type, summary: the log of changes."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("site_id"), F.col("ts").cast("timestamp_ntz").alias("detected_at"), F.col("event_type").alias("change_type"), F.col("props").alias("summary"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, scope_id, job_type, status, finished_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("scope_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("finished_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, position, executor, body: what a chain of acquisition attempts returned."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), F.col("role").alias("executor"), F.col("text").alias("body"))


# ---- the same in SQL ----

PATH = "regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
SCHEME = "regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
NETLOC = "regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
QUERY = "regexp_extract(trim({u}), '^[^?#]*\\?([^#]*)', 1)"


def sql_path(u: str) -> str:
    return PATH.format(u=u)


def sql_origin(u: str) -> str:
    return f"lower({SCHEME.format(u=u)} || '://' || {NETLOC.format(u=u)})"


def sql_query(u: str) -> str:
    """The sorted query without tracking keys."""
    decoded = "url_decode(replace(regexp_extract(p, '{}', 1), '+', ' '))"
    pairs = f"list_transform(list_filter(string_split({QUERY.format(u=u)}, '&'), lambda p: p <> ''), lambda p: {{'key': {decoded.format('^([^=]*)')}, 'value': {decoded.format('^[^=]*=(.*)$')}}})"
    encoded = "replace(url_encode(p.{}), '%20', '+')"
    kept = f"list_filter({pairs}, lambda p: NOT (starts_with(lower(p.key), 'utm_') OR lower(p.key) IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')))"
    return f"coalesce(list_aggregate(list_transform(list_sort({kept}), lambda p: {encoded.format('key')} || '=' || {encoded.format('value')}), 'string_agg', '&'), '')"


def sql_request(u: str) -> str:
    q = sql_query(u)
    return f"CASE WHEN {SCHEME.format(u=u)} <> '' AND {NETLOC.format(u=u)} <> '' THEN {sql_origin(u)} || CASE WHEN {sql_path(u)} = '' THEN '/' ELSE {sql_path(u)} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END ELSE '' END"


def sql_canonical(u: str) -> str:
    q = sql_query(u)
    path = f"CASE WHEN {sql_path(u)} IN ('', '/') THEN '/' ELSE regexp_replace({sql_path(u)}, '/+$', '') END"
    return f"CASE WHEN {SCHEME.format(u=u)} <> '' AND {NETLOC.format(u=u)} <> '' THEN {sql_origin(u)} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END ELSE '' END"


def sql_segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def sql_prefix(path: str, level: int) -> str:
    return f"'/' || coalesce(list_aggregate({sql_segments(path)}[1:{level}], 'string_agg', '/'), '')"


CAPTURES = """captures AS (
  SELECT r.run_id, p.page_id, p.url, CASE WHEN r.run_id = 2 AND p.page_id % 3 = 0 THEN p.html || '<!-- v2 -->' ELSE p.html END AS html
  FROM pages p, (VALUES (1), (2)) r(run_id) WHERE (r.run_id = 1 AND p.page_id % 7 <> 0) OR (r.run_id = 2 AND p.page_id % 5 <> 0)
)"""
SNAPSHOTS = f"""{CAPTURES}, snapshots AS (
  SELECT (run_id * 1000000000 + page_id)::BIGINT AS id, run_id, page_id, {sql_origin('url')} AS site, {sql_canonical('url')} AS canonical_url,
    {sql_path('url')} AS path, sha256(html) AS content_hash FROM captures
)"""
FILES = """files AS (
  SELECT doc_id AS id, (1 + (doc_id // 20) % 2)::INT AS run_id, doc_id % (SELECT nullif(count(*), 0) FROM pages) AS page_id, source AS site,
    'https://' || source || '.example.org/files/' || (doc_id // 40)::VARCHAR || '.pdf' AS download_url, sha256(text) AS sha256,
    CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'pdf' END AS doc_type, length(text)::BIGINT AS file_size FROM documents
)"""
LINKS = "regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)"
ABSOLUTE = f"list_sort(list_distinct(list_filter(list_transform({LINKS}, lambda x: CASE WHEN starts_with(x, '/') THEN {sql_origin('url')} || x ELSE x END), lambda x: regexp_matches(x, '^https?://'))))"
PAGE_GRAPH = f"""site_pages AS (
  SELECT url, html, {sql_origin('url')} AS site, {sql_canonical('url')} AS page, {sql_prefix(sql_path('url'), 1)} AS section FROM pages
), anchors AS (SELECT site, page, unnest({ABSOLUTE}) AS link FROM site_pages WHERE page <> ''), edges AS (
  SELECT site || '/' AS "from", site || section AS "to" FROM site_pages WHERE page <> '' UNION SELECT site || section, page FROM site_pages WHERE page <> ''
  UNION SELECT page, {sql_canonical('link')} FROM anchors WHERE {sql_origin('link')} = site
)"""
CHANGES = "changes AS (SELECT event_id AS id, user_id AS site_id, ts AS detected_at, event_type AS change_type, props AS summary FROM events)"
JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS scope_id, o_orderpriority AS job_type, o_orderstatus AS status, o_orderdate AS finished_at FROM orders)"
ATTEMPTS = "attempts AS (SELECT conv_id AS request_id, turn AS position, role AS executor, text AS body FROM conversations)"
