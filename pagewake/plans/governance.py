"""Queries over access rules, lineage and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import html
from pagewake.operators import governance, graph
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import SNAPSHOTS

#: A robots file that the views give to every site whose name has an even length; odd ones have none.
ROBOTS = "User-agent: *\nDisallow: /en\nAllow: /en/1\n\nUser-agent: monitor\nUser-agent: other\nDisallow: /de/*1$\nDisallow:\nAllow: /fr # all\nDisallow: /fr/2\n"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = views.snapshots(spark, sf_dir).select("site").distinct()
    return governance.parse_robots(sites.where(F.length("site") % 2 == 0).select("site", F.lit(ROBOTS).alias("body")), "site", "body")


@register(f"WITH {SNAPSHOTS}, s AS (SELECT DISTINCT site FROM snapshots WHERE length(site) % 2 = 0) SELECT site, line, agent, allow, pattern FROM s, (VALUES (1, '*', false, '/en'), (2, '*', true, '/en/1'), (6, 'monitor', false, '/de/*1$'), (6, 'other', false, '/de/*1$'), (8, 'monitor', true, '/fr'), (8, 'other', true, '/fr'), (9, 'monitor', false, '/fr/2'), (9, 'other', false, '/fr/2')) r(line, agent, allow, pattern)")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir)


@register(
    f"""WITH {SNAPSHOTS} SELECT id, CASE WHEN length(site) % 2 = 1 THEN true WHEN starts_with(path, '/fr/2') THEN false WHEN regexp_matches(path, '^/de/.*1$') THEN false ELSE true END AS allowed,
    CASE WHEN length(site) % 2 = 1 THEN 0 WHEN starts_with(path, '/fr/2') THEN 5 WHEN regexp_matches(path, '^/de/.*1$') THEN 5 WHEN starts_with(path, '/fr') THEN 3 ELSE 0 END AS specificity FROM snapshots WHERE run_id = 1"""
)
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir).where("run_id = 1")
    return governance.allowed(s, governance.selected_rules(_rules(spark, sf_dir), "site", "Monitor"), "site", "path", "id")


@register("WITH t AS (SELECT event_id AS id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM events) SELECT id, w / 1000000.0 AS waited FROM t WHERE w / 1000000.0 < 600")
def pacing_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return governance.pacing_breaches(e, "user_id", "ts", 600).select("id", "waited")


@register(
    """WITH RECURSIVE e AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1000000.0 AS s FROM events), w AS (
      SELECT user_id, min(s) AS start FROM e GROUP BY user_id
      UNION ALL SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + 21600) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + 21600)
    ), t AS (SELECT e.id, e.user_id, e.s, w.start FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.s >= w.start), n AS (SELECT id, start, row_number() OVER (PARTITION BY user_id, start ORDER BY s, id) AS slot FROM t)
    SELECT id, start AS window_start, slot, slot <= 5 AS admitted FROM n"""
)
def budget_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours and five requests for each user."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", at)
    return governance.budget_windows(e, "user_id", "at", 21_600, 5)


@register("WITH t AS (SELECT conv_id, turn, 'http' || CASE WHEN turn % 3 = 0 THEN 's' ELSE '' END || '://h/' || turn AS from_url, 'http' || CASE WHEN (turn + 1) % 3 = 0 THEN 's' ELSE '' END || '://h/' || (turn + CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END) AS to_url FROM conversations), l AS (SELECT *, lag(to_url) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, turn AS ordinal, coalesce(before <> from_url, false) AS broken, starts_with(from_url, 'https:') AND starts_with(to_url, 'http:') AS downgrade FROM l WHERE coalesce(before <> from_url, false) OR (starts_with(from_url, 'https:') AND starts_with(to_url, 'http:'))")
def redirect_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    def url(n):
        return F.concat(F.lit("http"), F.when(n % 3 == 0, "s").otherwise(""), F.lit("://h/"))

    turn = F.col("turn")
    hops = c.select("conv_id", turn.alias("ordinal"), F.concat(url(turn), turn.cast("string")).alias("from_url"), F.concat(url(turn + 1), (turn + F.when(F.col("conv_id") % 5 == 0, 2).otherwise(1)).cast("string")).alias("to_url"))
    return governance.redirect_breaks(hops, "conv_id").select("conv_id", "ordinal", "broken", "downgrade")


#: A walk of four levels from the root of each site; `best` has each node's least depth.
WALK = f"""WITH RECURSIVE {views.PAGE_GRAPH}, w AS (SELECT DISTINCT site AS scope, site || '/' AS node, 0 AS depth FROM site_pages WHERE page <> ''
    UNION SELECT w.scope, e."to", w.depth + 1 FROM w JOIN edges e ON e."from" = w.node WHERE w.depth < 4), best AS (SELECT scope, node, min(depth) AS depth FROM w GROUP BY scope, node)"""


@register(f"""{WALK} SELECT b.scope, b.node, b.depth, min(a.node) AS parent FROM best b LEFT JOIN edges e ON e."to" = b.node AND b.depth > 0 LEFT JOIN best a ON a.scope = b.scope AND a.node = e."from" AND a.depth = b.depth - 1 GROUP BY b.scope, b.node, b.depth""")
def link_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of four levels from each site's root reaches."""
    return graph.traverse(views.page_graph(spark, sf_dir), views.page_seeds(spark, sf_dir), 4)


@register("SELECT page_id AS child, page_id AS parent FROM pages WHERE page_id % 50 = 0")
def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over all pages, two children each, but for every fiftieth page, which has a loop instead: only the loops are left."""
    p = table(spark, sf_dir, "pages")
    e = p.select(F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("child"), F.col("page_id").alias("parent")).where("parent % 50 <> 0 AND child % 50 <> 0")
    loops = p.where("page_id % 50 = 0").select(F.col("page_id").alias("child"), F.col("page_id").alias("parent"))
    return graph.cyclic(e.unionByName(loops))


@register()
def strict_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", html.normal_http_url("url").alias("strict_url"))


_KINDS = ("valid_200", *governance.DISPOSITIONS)


@register(
    f"""WITH t AS (SELECT doc_id, [{", ".join(f"'{k}'" for k in _KINDS)}][doc_id % {len(_KINDS)} + 1] AS kind, n_chars > 1000 AS ok FROM documents) SELECT doc_id,
    CASE kind WHEN 'valid_200' THEN CASE WHEN ok THEN 'allow' ELSE 'reject' END {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in governance.DISPOSITIONS.items())} END AS outcome,
    CASE kind WHEN 'valid_200' THEN CASE WHEN ok THEN 'robots.allowed' ELSE 'robots.disallowed' END {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in governance.DISPOSITIONS.items())} END AS reason,
    kind IN ('timeout', 'dns_error', 'network_error') AS retryable FROM t"""
)
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("kind", F.get(F.array(*map(F.lit, _KINDS)), F.col("doc_id") % len(_KINDS)))
    return d.select("doc_id", governance.disposition(F.col("kind"), F.col("n_chars") > 1000).alias("d")).select("doc_id", "d.*")


@register("SELECT page_id, page_id % 3 < 2 AS has_userinfo FROM pages")
def url_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with user information, plain in a third of the rows and escaped in another."""
    made = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("://u:p@"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("://"), F.lit(":%2F%2Fu:p%2540"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", governance.has_userinfo(made).alias("has_userinfo"))
