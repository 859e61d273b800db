"""Queries that diagnose the sitemaps of all sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import urls
from pagewake.operators import sitemaps
from pagewake.plans.registry import register
from pagewake.sources.tables import table
from pagewake.sources.views import sql_canonical, sql_origin, sql_path, sql_prefix

#: Small budgets, so that many sites are cut: by documents inside an index, by occurrences inside a list of pages.
BUDGETS = sitemaps.Budgets(requests=64, depth=3, documents=7, occurrences=13)


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(urls.origin(u).alias("site"), urls.canonical_url(u).alias("page"), urls.path_prefix(urls.path_of(u), 1).alias("section")).where("page <> ''")


def _diagnosis(spark: SparkSession, sf_dir: str) -> sitemaps.Diagnosis:
    """Each site's sitemap.xml names two indexes; these name the site's sections, the second one all of them again; a section lists its captured pages.

    Robots files have no directives and close /de.
    """
    p = sitemaps._kept(_site_pages(spark, sf_dir))
    section_map = F.concat("site", "section", F.lit(".xml"))

    def listing(rows: DataFrame, url, kind: str, loc) -> DataFrame:
        found = rows.select("site", url.alias("url"), loc.alias("loc")).distinct().groupBy("site", "url").agg(F.array_sort(F.collect_list("loc")).alias("locs"))
        return found.select("url", F.col("site").alias("origin"), F.lit(kind).alias("root_type"), F.transform("locs", lambda x: F.struct(x.alias("raw"), x.alias("url"), F.col("site").alias("origin"))).alias("locations"))

    def index(n: int):
        return F.concat("site", F.lit(f"/index{n}.xml"))

    top = listing(p.select("site", F.explode(F.array(index(1), index(2))).alias("to")), F.concat("site", F.lit("/sitemap.xml")), sitemaps.INDEX, F.col("to"))
    parts = [listing(rows, index(n), sitemaps.INDEX, section_map) for n, rows in ((1, p.where(F.length("section") % 2 == 1)), (2, p))]
    pages = listing(p, section_map, sitemaps.URLSET, F.col("page"))
    documents = top.unionByName(parts[0]).unionByName(parts[1]).unionByName(pages).select("*", F.lit(None).cast("string").alias("final_url"), F.lit("success").alias("outcome"), F.sha2("url", 256).alias("sha256"), F.lit(1).alias("requests"), F.lit(True).alias("allowed"))
    names = p.select("site").distinct()
    sites = names.select("site", F.lit("success").alias("robots"), F.lit(None).cast("string").alias("robots_error"), F.array().cast("array<string>").alias("directives"), F.lit(True).alias("root_allowed"))
    allowed = ~F.startswith(urls.path_of(F.col("url")), F.lit("/de"))
    return sitemaps.diagnose(sites, documents, names.select("site", F.col("site").alias("origin")), allowed, BUDGETS)


#: The same walk, one document of each site a step.
WALK = f"""WITH RECURSIVE p AS (
  SELECT DISTINCT {sql_origin('url')} AS site, {sql_canonical('url')} AS page, {sql_prefix(sql_path('url'), 1)} AS section FROM pages WHERE {sql_canonical('url')} <> ''
), listed AS (
  SELECT site, site || '/sitemap.xml' AS url, true AS is_index, unnest([site || '/index1.xml', site || '/index2.xml']) AS loc FROM p
  UNION SELECT site, site || '/index1.xml', true, site || section || '.xml' FROM p WHERE length(section) % 2 = 1
  UNION SELECT site, site || '/index2.xml', true, site || section || '.xml' FROM p
  UNION SELECT site, site || section || '.xml', false, page FROM p
), doc AS (
  SELECT url, bool_or(is_index) AS is_index, list(loc ORDER BY loc) AS locs FROM listed GROUP BY url
), walk AS (
  SELECT DISTINCT site, [{{'q': 1::BIGINT, 'url': site || '/sitemap.xml', 'depth': 0}}] AS queue, 1::BIGINT AS u, 1::BIGINT AS d, 1::BIGINT AS r, 1::BIGINT AS n, []::VARCHAR[] AS seen,
    NULL::BIGINT AS q, NULL::VARCHAR AS url, NULL::INT AS depth, NULL::VARCHAR AS told, []::VARCHAR[] AS shown, false AS is_index, 0::BIGINT AS taken, NULL::VARCHAR AS over FROM p
  UNION ALL
  SELECT site, CASE WHEN is_index THEN list_concat(queue[2:], list_transform(range(1, taken + 1), lambda i: {{'q': n + i, 'url': locs[i], 'depth': item.depth + 1}})) ELSE queue[2:] END,
    u + taken + CASE WHEN over = 'sitemap_document_budget_exhausted' THEN 1 ELSE 0 END, d + CASE WHEN is_index THEN taken ELSE 0 END, r + 1 + CASE WHEN is_index AND over IS NOT NULL THEN 1 ELSE 0 END,
    n + CASE WHEN is_index THEN taken + CASE WHEN over IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END, list_append(seen, item.url), item.q, item.url, item.depth,
    CASE WHEN again THEN 'duplicate_document_url' WHEN missing THEN 'deterministic' ELSE 'parsed' END, CASE WHEN is_index THEN [locs[taken + 1]] ELSE locs[1:taken] END, is_index, taken, over
  FROM (
    SELECT *, CASE WHEN taken < len(locs) THEN CASE WHEN taken >= {BUDGETS.occurrences} - u THEN 'url_occurrence_budget_exhausted' ELSE 'sitemap_document_budget_exhausted' END END AS over FROM (
      SELECT *, least(len(locs), {BUDGETS.occurrences} - u, CASE WHEN is_index THEN {BUDGETS.documents} - d ELSE len(locs) END) AS taken FROM (
        SELECT w.site, w.queue, w.queue[1] AS item, w.u, w.d, w.r, w.n, w.seen, list_contains(w.seen, w.queue[1].url) AS again, x.url IS NULL AS missing,
          coalesce(x.is_index AND NOT list_contains(w.seen, w.queue[1].url), false) AS is_index, CASE WHEN x.url IS NULL OR list_contains(w.seen, w.queue[1].url) THEN [] ELSE x.locs END AS locs
        FROM walk w LEFT JOIN doc x ON x.url = w.queue[1].url WHERE len(w.queue) > 0)))
)"""


@register(
    f"""{WALK} SELECT site, q, url, depth, told FROM walk WHERE q IS NOT NULL UNION ALL
    SELECT site, n AS q, shown[1] AS url, depth + 1 AS depth, over AS told FROM walk WHERE is_index AND over IS NOT NULL"""
)
def sitemap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One disposition for each document of each site's queue."""
    return _diagnosis(spark, sf_dir).queue.select("site", "q", "url", "depth", "told")


_ENTRIES = f"entry AS (SELECT site, q, i AS entry, shown[i] AS url, starts_with({sql_path('shown[i]')}, '/de') AS off FROM (SELECT *, unnest(range(1, len(shown) + 1)) AS i FROM walk WHERE q IS NOT NULL AND NOT is_index AND told = 'parsed'))"


@register(
    f"""{WALK}, {_ENTRIES}, first AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY q, entry) AS nth FROM entry WHERE NOT off), page AS (
      SELECT site, count(*) FILTER (nth = 1) AS accepted, count(*) FILTER (nth > 1) AS repeated FROM first GROUP BY site
    ), off AS (SELECT site, count(*) AS disallowed FROM entry WHERE off GROUP BY site), used AS (
      SELECT site, max(r) AS requests, max(d) AS documents, max(u) AS occurrences, bool_or(told = 'deterministic') AS failed, bool_or(over IS NOT NULL) AS cut,
        list_distinct(list(over) FILTER (over IS NOT NULL)) AS overs, list(over ORDER BY q) FILTER (over IS NOT NULL) AS ordered FROM walk GROUP BY site
    ), told AS (
      SELECT u.*, coalesce(accepted, 0) AS accepted, coalesce(repeated, 0) AS repeated, coalesce(disallowed, 0) AS disallowed FROM used u LEFT JOIN page p ON p.site = u.site LEFT JOIN off o ON o.site = u.site
    ), ranked AS (
      SELECT *, CASE WHEN disallowed > 0 AND accepted = 0 THEN 1 WHEN accepted > 0 THEN CASE WHEN cut OR failed THEN 2 ELSE 3 END WHEN NOT cut AND NOT failed THEN 5 ELSE 6 END AS priority FROM told
    )
    SELECT site, CASE priority WHEN 2 THEN 'partial' WHEN 3 THEN 'complete' WHEN 5 THEN 'complete' ELSE 'blocked' END AS status, priority, requests, documents, occurrences, accepted, repeated, disallowed,
      concat_ws(',', CASE WHEN priority = 1 THEN 'all_canonical_page_candidates_disallowed_by_robots' END, CASE WHEN failed THEN 'deterministic_failure' END,
        CASE WHEN ordered[1] IS NOT NULL THEN ordered[1] END, CASE WHEN len(overs) > 1 THEN list_filter(overs, lambda o: o <> ordered[1])[1] END) AS reasons FROM ranked"""
)
def site_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each site's diagnosis with its reasons, and what it used of its budgets."""
    found = _diagnosis(spark, sf_dir).sites
    return found.select("site", "status", "priority", "requests", "documents", "occurrences", "accepted", "repeated", "disallowed", F.array_join("reasons", ",").alias("reasons"))
