"""Bounded crawls of many scopes at once over captures: first in, first out, with budgets counted in requests.

All scopes walk together, one round of joins a level. A page's place in its scope's queue is the rank of its first link, by the place of the page that holds it and
the link's place on that page. Ranks are cut at the budget before they are shuffled, so a scope never holds more than its budget of pages, whatever its links.

A request is spent on every page taken from the queue: on those that fail, lead out of scope, or lead to a page that the scope has already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.functions import urls
from pagewake.sources.folders import shared_folder

# What becomes of a requested page.
TRACKED, FAILED, EXTERNAL, REPEATED, ENTRY = "tracked", "failed", "external", "duplicate", "entrypoint"


@dataclass(frozen=True)
class Limits:
    """Requests for pages, depth of the walk, and requests for files of each scope."""

    pages: int = 100
    depth: int = 3
    files: int = 20


@dataclass(frozen=True)
class Crawl:
    """requests: scope, q, url, depth, page (canonical final URL), told. files: scope, n, url, on_page, told. edges: scope, from, to. totals: one row a scope."""

    requests: DataFrame
    files: DataFrame
    edges: DataFrame
    totals: DataFrame


def _kept(rows: DataFrame) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _inside(link: Column) -> Column:
    return urls.in_scope(link, F.col("origin"), F.col("prefixes"))


def crawl(scopes: DataFrame, captures: DataFrame, links: DataFrame, limits: Limits = Limits()) -> Crawl:
    """Walks each scope from its seed.

    scopes: scope, seed (canonical), origin, prefixes (of pages). captures: url (canonical), accepted, final (canonical URL where its redirects end); a URL without one fails.
    links: page (the captured URL), place, link (canonical), is_file. Both are written once, links by their page. Files are in scope by origin alone; a final URL of a file leads
    no further.
    """
    links = _kept(links.select("page", "place", "link", "is_file").repartition("page"))
    captures = _kept(captures.select("url", "accepted", "final").repartition("url"))
    of_scope = _kept(scopes.select("scope", "seed", "origin", "prefixes"))
    one = F.lit(1).cast("bigint")
    frontier = _kept(of_scope.select("scope", one.alias("q"), F.col("seed").alias("url"), F.lit(None).cast("string").alias("parent")))
    requests, link_rows, queued, pages = [], [], [frontier.select("scope", "url")], []
    for depth in range(limits.depth + 1):
        x = frontier.join(captures, "url", "left").join(of_scope, "scope").withColumn("page", F.when(F.coalesce("accepted", F.lit(False)), F.coalesce("final", "url")))
        inside = _inside(F.col("page"))
        x = x.withColumn("told", F.when(F.col("page").isNull(), FAILED).when(inside, TRACKED).when((F.col("page") == F.col("seed")) & F.lit(depth == 0), ENTRY).otherwise(EXTERNAL))
        if pages:
            x = x.join(_all(pages).select("scope", "page", F.lit(True).alias("had")), ["scope", "page"], "left")
        else:
            x = x.withColumn("had", F.lit(None).cast("boolean"))
        first = F.min(F.when(F.col("told") == TRACKED, F.col("q"))).over(Window.partitionBy("scope", "page"))
        again = (F.col("told") == TRACKED) & (F.col("had").isNotNull() | (F.col("q") > first))
        x = _kept(x.withColumn("told", F.when(again, REPEATED).otherwise(F.col("told"))).select("scope", "q", "url", F.lit(depth).alias("depth"), "parent", "page", "told", "origin", "prefixes"))
        requests.append(x)
        pages.append(x.where(F.col("told") == TRACKED).select("scope", "page", F.col("q").alias("page_q")))
        met = x.where(F.col("told").isin(TRACKED, ENTRY)).select("scope", "q", F.col("url").alias("at"), "page", "told", "origin", "prefixes").join(links.withColumnRenamed("page", "at"), "at")
        met = met.withColumn("fits", F.when(F.col("is_file"), urls.origin(F.col("link")) == F.col("origin")).otherwise(_inside(F.col("link"))))
        met = _kept(met.select("scope", "q", "place", "link", "is_file", "fits", "told", F.when(F.col("told") == TRACKED, F.col("page")).alias("page")))
        link_rows.append(met)
        if depth == limits.depth:
            break
        found = met.where("fits AND NOT is_file").groupBy("scope", F.col("link").alias("url")).agg(F.min(F.struct("q", "place", F.col("page").alias("parent"))).alias("f"))
        fresh = found.join(_all(queued), ["scope", "url"], "left_anti").join(_all(pages).withColumnRenamed("page", "url"), ["scope", "url"], "left").where("page_q IS NULL OR page_q > f.q").drop("page_q")
        rank = F.row_number().over(Window.partitionBy("scope").orderBy("f.q", "f.place"))
        cut = fresh.withColumn("n", rank).where(F.col("n") <= limits.pages)
        used = _all(requests).groupBy("scope").agg(F.max("q").alias("used"))
        frontier = _kept(cut.join(used, "scope").withColumn("q", F.col("used") + F.col("n")).where(F.col("q") <= limits.pages).select("scope", "q", "url", F.col("f.parent").alias("parent")))
        queued.append(frontier.select("scope", "url"))
        if frontier.isEmpty():
            break
    asked, told_links = _all(requests), _all(link_rows)
    files = _files(told_links, captures, of_scope, limits)
    edges = asked.where(F.col("told").isin(TRACKED, REPEATED) & F.col("parent").isNotNull()).select("scope", F.col("parent").alias("from"), F.col("page").alias("to")).distinct()
    return Crawl(asked.select("scope", "q", "url", "depth", "page", "told"), files, edges, _totals(asked, told_links, files))


def _files(met: DataFrame, captures: DataFrame, of_scope: DataFrame, limits: Limits) -> DataFrame:
    """Requested files in order: the first link of each, without those that an earlier one led to, as many as the budget admits."""
    first = met.where(F.col("is_file") & F.col("fits") & F.col("page").isNotNull()).groupBy("scope", F.col("link").alias("url")).agg(F.min(F.struct("q", "place", "page")).alias("f"))
    led = first.join(captures, "url", "left").withColumn("final", F.when(F.col("accepted"), F.coalesce("final", "url")))
    targets = led.where(F.col("final") != F.col("url")).groupBy("scope", F.col("final").alias("url")).agg(F.min("f").alias("before"))
    kept = led.join(targets, ["scope", "url"], "left").where("before IS NULL OR f < before OR f = before")
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("f.q", "f.place"))
    cut = kept.withColumn("n", rank).where(F.col("n") <= limits.files).join(of_scope.select("scope", "origin"), "scope")
    told = F.when(F.col("final").isNull(), FAILED).when(urls.origin(F.col("final")) != F.col("origin"), EXTERNAL).otherwise(TRACKED)
    return _kept(cut.select("scope", F.col("n").cast("bigint").alias("n"), "url", F.col("f.page").alias("on_page"), told.alias("told")))


def _totals(asked: DataFrame, met: DataFrame, files: DataFrame) -> DataFrame:
    """Requests, pages, failures, skipped pages and files of each scope."""
    def count(told: str, name: str) -> Column:
        return F.count_if(F.col("told") == told).alias(name)

    a = asked.groupBy("scope").agg(F.count("*").alias("requests"), count(TRACKED, "pages"), count(FAILED, "page_failures"), count(EXTERNAL, "led_out"), count(REPEATED, "led_back"))
    m = met.where("NOT is_file OR page IS NOT NULL").groupBy("scope").agg(F.count_if(~F.col("fits") & ~F.col("is_file")).alias("links_out"), F.count_if(~F.col("fits") & F.col("is_file")).alias("skipped_external_files"))
    f = files.groupBy("scope").agg(count(TRACKED, "files"), count(FAILED, "file_failures"))
    x = a.join(m, "scope", "left").join(f, "scope", "left").na.fill(0)
    return x.select("scope", "requests", "pages", "page_failures", (F.col("led_out") + F.col("links_out")).alias("skipped_external_pages"), F.col("led_back").alias("led_back"), "files", "file_failures", "skipped_external_files")
