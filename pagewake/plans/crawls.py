"""Queries over crawls with budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewake.operators import crawl
from pagewake.plans.registry import register
from pagewake.sources import views

LIMITS = crawl.Limits(pages=9, depth=4, files=3)


def _crawl(spark: SparkSession, sf_dir: str) -> crawl.Crawl:
    """Each site from its root over the page graph. URLs with a query lead to the page without it, every sixth page by the length of its URL fails, and every second page has a file beside it."""
    edges = crawl._kept(views.page_graph(spark, sf_dir))
    seeds = views.page_seeds(spark, sf_dir)
    size = F.length("to")
    deep = F.regexp_count("to", F.lit("/")) > 3
    nodes = edges.select("to").distinct()
    captures = nodes.select(F.col("to").alias("url"), (~deep | (size % 6 != 0)).alias("accepted"), F.when(F.contains("to", F.lit("?")), F.substring_index("to", "?", 1)).alias("final"))
    roots = seeds.select(F.col("node").alias("url"), F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("final")).distinct()
    file = F.concat(F.substring_index("to", "?", 1), F.lit(".pdf"))
    beside = nodes.where(deep & (size % 2 == 0)).select(F.col("to").alias("page"), file.alias("link"), F.lit(True).alias("is_file"))
    files = beside.select(F.col("link").alias("url"), (F.length("link") % 5 != 0).alias("accepted"), F.lit(None).cast("string").alias("final")).distinct()
    links = edges.select(F.col("from").alias("page"), F.col("to").alias("link"), F.lit(False).alias("is_file")).unionByName(beside)
    placed = links.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("link", "is_file")))
    known = captures.unionByName(roots.join(captures, "url", "left_anti")).unionByName(files)
    scopes = seeds.select("scope", F.col("node").alias("seed"), F.col("scope").alias("origin"), F.array(F.lit("/")).alias("prefixes"))
    return crawl.crawl(scopes, known, placed, LIMITS)


#: One request of each site a step; lists hold the queue, what was queued, what was reached, and the files asked for.
WALK = f"""WITH RECURSIVE {views.PAGE_GRAPH}, node AS (
  SELECT DISTINCT "to" AS url, length("to") - length(replace("to", '/', '')) > 3 AS deep FROM edges
), cap AS (
  SELECT url, NOT deep OR length(url) % 6 <> 0 AS accepted, string_split(url, '?')[1] AS final FROM node
  UNION SELECT DISTINCT site || '/', true, site || '/' FROM site_pages WHERE page <> '' AND site || '/' NOT IN (SELECT url FROM node)
), link AS (
  SELECT DISTINCT "from" AS page, "to" AS link FROM edges
), listed AS (SELECT page, list(link ORDER BY link) AS links FROM link GROUP BY page), step AS (
  SELECT DISTINCT site AS scope, [{{'url': site || '/', 'depth': 0, 'parent': NULL::VARCHAR}}] AS queue, [site || '/'] AS queued, []::VARCHAR[] AS had, []::VARCHAR[] AS asked_files, 0::BIGINT AS q, NULL::VARCHAR AS url, NULL::INT AS depth, NULL::VARCHAR AS parent, NULL::VARCHAR AS page, NULL::VARCHAR AS told, 0::BIGINT AS links_out FROM site_pages WHERE page <> ''
  UNION ALL
  SELECT scope, list_concat(queue[2:], list_transform(fresh, lambda x: {{'url': x, 'depth': item.depth + 1, 'parent': page}})), list_concat(queued, fresh), CASE WHEN told = 'tracked' THEN list_append(had, page) ELSE had END,
    CASE WHEN told = 'tracked' AND file IS NOT NULL AND NOT list_contains(asked_files, file) AND len(asked_files) < {LIMITS.files} THEN list_append(asked_files, file) ELSE asked_files END, q + 1, item.url, item.depth, item.parent, page, told, 0
  FROM (
    SELECT *, CASE WHEN told = 'tracked' AND item.depth < {LIMITS.depth} THEN list_filter(links, lambda x: starts_with(x, scope || '/') AND NOT list_contains(queued, x) AND NOT list_contains(had, x) AND x <> page) ELSE [] END AS fresh,
      CASE WHEN length(item.url) - length(replace(item.url, '/', '')) > 3 AND length(item.url) % 2 = 0 THEN string_split(item.url, '?')[1] || '.pdf' END AS file FROM (
      SELECT s.scope, s.queue, s.queue[1] AS item, s.queued, s.had, s.asked_files, s.q, CASE WHEN c.accepted THEN c.final END AS page, coalesce(l.links, []) AS links,
        CASE WHEN NOT coalesce(c.accepted, false) THEN 'failed' WHEN NOT starts_with(c.final, s.scope || '/') THEN 'external' WHEN list_contains(s.had, c.final) THEN 'duplicate' ELSE 'tracked' END AS told
      FROM step s LEFT JOIN cap c ON c.url = s.queue[1].url LEFT JOIN listed l ON l.page = s.queue[1].url WHERE len(s.queue) > 0 AND s.q < {LIMITS.pages}))
)"""


@register(f"{WALK} SELECT scope, q, url, depth, page, told FROM step WHERE q > 0")
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request of each site in order and what became of it."""
    return _crawl(spark, sf_dir).requests


@register(f"{WALK} SELECT DISTINCT scope, parent AS \"from\", page AS \"to\" FROM step WHERE told IN ('tracked', 'duplicate') AND parent IS NOT NULL")
def crawl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between tracked pages: those through which a page was found or met again by a redirect."""
    return _crawl(spark, sf_dir).edges


@register(f"{WALK}, last AS (SELECT scope, arg_max(asked_files, q) AS files FROM step GROUP BY scope), f AS (SELECT scope, unnest(files) AS url, unnest(range(1, len(files) + 1)) AS n FROM last) SELECT scope, n, url, CASE WHEN length(url) % 5 <> 0 THEN 'tracked' ELSE 'failed' END AS told FROM f")
def crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each site's budget admits, in the order of their pages."""
    return _crawl(spark, sf_dir).files.drop("on_page")
