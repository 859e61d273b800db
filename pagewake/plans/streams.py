"""Queries that run a table through a stateful stream and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import texts
from pagewake.operators import site_events as changes_of_sites
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.folders import shared_folder
from pagewake.sources.tables import table
from pagewake.streaming import gateway
from pagewake.streaming.monitor import Monitor


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events as a stream of requests: id, origin, at, ts."""
    path = f"{sf_dir}/events.parque[t]"  # as a pattern, it may be a file or a folder
    ts = F.col("ts").cast("timestamp")
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path).select(F.col("event_id").alias("id"), F.col("user_id").alias("origin"), (F.unix_micros(ts) / 1_000_000).alias("at"), ts.alias("ts"))


def anchored(seconds: float) -> str:
    """Windows of a user: the first opens with the first request, the next one with the first request after its end."""
    return f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1000000.0 AS s FROM events), w AS (
      SELECT user_id, min(s) AS start FROM e GROUP BY user_id
      UNION ALL SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + {seconds}) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + {seconds})
    ), t AS (SELECT e.id, e.user_id, e.s, w.start FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.s >= w.start)"""


@register(f"{anchored(21_600)} SELECT id, start AS window_start, row_number() OVER (PARTITION BY user_id, start ORDER BY s, id) AS slot, row_number() OVER (PARTITION BY user_id, start ORDER BY s, id) <= 5 AS admitted FROM t")
def stream_budget_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours and five requests for each user, with state."""
    return gateway.drained(spark, gateway.budget_windows(_requests(spark, sf_dir), 21_600, 5))


@register(f"{anchored(36_000)}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, id) AS n, row_number() OVER (PARTITION BY user_id, start ORDER BY s, id) AS k FROM t) SELECT id, CASE WHEN k > 1 THEN 'hit' WHEN n = 1 THEN 'miss' ELSE 'expired' END AS outcome, start AS observed_at, start + 36000 AS expires_at FROM r")
def stream_policy_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that hold ten hours: whether each request of a user hit one."""
    return gateway.drained(spark, gateway.cached_policies(_requests(spark, sf_dir), 36_000.0))


def _site_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, seq, text, links: each page as a site of its own, captured by both runs; of every second page the first run kept no links, and the second run adds a file."""
    c = views.captures(spark, sf_dir)
    added = F.when((F.col("run_id") == 2) & (F.col("page_id") % 4 == 0), F.concat(F.lit("https://files.example.org/"), F.col("page_id").cast("string"), F.lit(".PDF?v=2")))
    kept = F.when((F.col("run_id") == 1) & (F.col("page_id") % 2 == 0), F.array().cast("array<string>")).otherwise(texts.links(F.col("html")))
    return c.select(F.col("page_id").cast("string").alias("site"), F.col("run_id").cast("bigint").alias("seq"), F.col("html").alias("text"), F.concat(kept, F.array_compact(F.array(added))).alias("links"))


_EVENTS = f"""WITH {views.CAPTURES}, l AS (
  SELECT page_id::VARCHAR AS site, run_id, html, list_concat(CASE WHEN run_id = 1 AND page_id % 2 = 0 THEN [] ELSE {views.LINKS} END, CASE WHEN run_id = 2 AND page_id % 4 = 0 THEN ['https://files.example.org/' || page_id || '.PDF?v=2'] ELSE [] END) AS links FROM captures
), f AS (
  SELECT a.site, b.run_id AS seq, a.html <> b.html AS changed, list_filter(b.links, lambda x: NOT list_contains(a.links, x)) AS fresh FROM l a JOIN l b ON a.site = b.site AND a.run_id = 1 AND b.run_id = 2
), d AS (SELECT *, list_filter(fresh, lambda x: regexp_matches(lower({views.sql_path('x')}), '\\.(pdf|docx|doc|xlsx|xls|pptx|ppt)$')) AS files FROM f)
SELECT site, seq, 'new_content' AS change_type, 'Content changed on ' || site AS summary, '' AS sample FROM d WHERE changed
UNION ALL SELECT site, seq, 'new_links', len(fresh) || ' new links found on ' || site, array_to_string(fresh[1:10], chr(10)) FROM d WHERE len(fresh) > 0
UNION ALL SELECT site, seq, 'new_document', len(files) || ' new document links on ' || site, array_to_string(files[1:10], chr(10)) FROM d WHERE len(files) > 0"""


@register(_EVENTS)
def site_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run found new on each site."""
    return changes_of_sites.events(_site_captures(spark, sf_dir))


@register(_EVENTS)
def monitor_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two batches that meet through versions of the sites' state, the second one run twice."""
    monitor = Monitor(f"{shared_folder(spark)}/monitor-{uuid.uuid4().hex}")
    captures = _site_captures(spark, sf_dir)
    for number in (0, 1, 1):
        monitor.apply(captures.where(F.col("seq") == number + 1), number)
    return monitor.events(spark).drop("batch")
