"""Change events of sites between one capture and the next: new content, new links, new documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.functions import texts, urls

#: Sample lines of an event.
SAMPLES = 10


def _event(kind: str, holds: Column, summary: Column, lines: Column) -> Column:
    return F.when(holds, F.struct(F.lit(kind).alias("change_type"), summary.alias("summary"), F.array_join(F.slice(lines, 1, SAMPLES), "\n").alias("sample")))


def events(captures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """site, seq, change_type, summary, sample of captures (site, seq, text, links) in order of seq, each against the site's one before.

    `known` holds the latest capture of sites met earlier; a site's first capture gives no event. New links are in page order
    with their repeats, documents are those of them that lead to files. Null texts and links count as empty.
    """
    none = F.array().cast("array<string>")
    rows = captures.select("site", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("links", none).alias("links"), F.lit(True).alias("new"))
    if known is not None:
        rows = rows.unionByName(known.select("site", "seq", "text", "links", F.lit(False).alias("new")))
    told = rows.select("site", "seq", "links", "new", texts.content_hash(F.col("text")).alias("hash"))
    w = Window.partitionBy("site").orderBy("new", "seq")
    pairs = told.withColumns({"old_hash": F.lag("hash").over(w), "old_links": F.lag("links").over(w)}).where(F.col("new") & F.col("old_hash").isNotNull())
    found = pairs.withColumn("fresh", texts.new_items(F.col("links"), F.col("old_links"))).withColumn("files", F.filter("fresh", urls.is_document))

    def count(column: str, what: str) -> Column:
        return F.concat(F.size(column).cast("string"), F.lit(f" new {what} on "), F.col("site"))

    made = F.array_compact(F.array(
        _event("new_content", F.col("hash") != F.col("old_hash"), F.concat(F.lit("Content changed on "), F.col("site")), none),
        _event("new_links", F.size("fresh") > 0, F.concat(F.size("fresh").cast("string"), F.lit(" new links found on "), F.col("site")), F.col("fresh")),
        _event("new_document", F.size("files") > 0, count("files", "document links"), F.col("files")),
    ))
    return found.select("site", "seq", F.explode(made).alias("e")).select("site", "seq", "e.*")


def latest(captures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """site, seq, text, links of the last capture of each site."""
    rows = captures.select("site", "seq", "text", "links", F.lit(True).alias("new"))
    if known is not None:
        rows = rows.unionByName(known.select("site", "seq", "text", "links", F.lit(False).alias("new")))
    last = rows.groupBy("site").agg(F.max_by(F.struct("seq", "text", "links"), F.struct("new", "seq")).alias("c"))
    return last.select("site", "c.*")
