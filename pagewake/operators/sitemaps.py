"""Sitemap diagnosis of many sites at once: a first-in-first-out walk over captured sitemap documents under budgets.

All sites walk together, one round of joins for each depth. A document's place in its site's queue, and what
it may still take of each budget, are prefix sums over the documents before it; their number in a site is bounded by
the budget of documents, so windows over a site's documents are small. Locations are never put into one group: they are
exploded from their documents and, where a page is listed more than once, reduced to its first place.

Each queued document gets one disposition. What stops a site (an unsafe location or document, or the last request) stops it at
that place: everything still queued is told so. Requests also pay for the rejection of a queued document.

`final_url` of a document is where its redirects end, so a final URL leads no further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.sources.folders import shared_folder

# The dispositions, reasons and outcomes of a diagnosis.
PARSED, EMPTY, QUEUED, ACCEPTED = "parsed", "completed_empty", "queued", "accepted"
SAME_URL, SAME_FINAL, SAME_DIGEST, SAME_PAGE = "duplicate_document_url", "duplicate_document_final_url", "duplicate_document_digest", "duplicate_page_url"
BAD_ORIGIN, DISALLOWED = "document_origin_not_approved", "sitemap_disallowed_by_robots"
NO_DOCUMENTS, NO_OCCURRENCES, NO_DEPTH, NO_REQUESTS = "sitemap_document_budget_exhausted", "url_occurrence_budget_exhausted", "sitemap_depth_budget_exhausted", "http_request_budget_exhausted"
AFTER_SAFETY, AFTER_BUDGET = "prior_safety_stop", "prior_budget_stop"
EMPTY_LOC, MALFORMED_LOC = "empty_sitemap_loc", "malformed_sitemap_loc"
CROSS_ORIGIN, PAGE_DISALLOWED = "cross_origin_requires_diagnosis", "robots_disallowed"
ALL_DISALLOWED, HOME_DISALLOWED = "all_canonical_page_candidates_disallowed_by_robots", "homepage_fallback_disallowed_by_robots"
INDEX, URLSET = "sitemapindex", "urlset"
TRANSIENT, DETERMINISTIC, SAFETY, TRUNCATION = "transient", "deterministic", "safety", "truncation"
SYNTAX = "xml_syntax_error"


@dataclass(frozen=True)
class Budgets:
    """What a site's diagnosis may take: requests, depth of indexes, sitemap documents, occurrences of URLs."""

    requests: int = 64
    depth: int = 3
    documents: int = 32
    occurrences: int = 50_000


@dataclass(frozen=True)
class Diagnosis:
    """queue: site, q, url, depth, parent_q, entry, told. pages: site, q, entry, url, told. sites: the verdict of each."""

    queue: DataFrame
    pages: DataFrame
    sites: DataFrame


def _kept(rows: DataFrame) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def _reason(kind: str, reason: Column, at: Column | None = None) -> Column:
    return F.struct((F.lit(0) if at is None else at).cast("bigint").alias("at"), F.lit(kind).alias("kind"), reason.alias("reason"))


def _reasons(*found: tuple[Column, str, Column]) -> Column:
    """Structs (at, kind, reason) of those that hold."""
    return F.array_compact(F.array(*[F.when(holds, _reason(kind, reason, F.col("q"))) for holds, kind, reason in found]))


def _waiting(rows: DataFrame, used: Column, exhausted: Column, intended: Column, b: Budgets) -> Column:
    """The disposition of what waits behind a stop, in the queue's order: rejections pay with requests while there are any."""
    place = F.row_number().over(Window.partitionBy("site").orderBy("q"))
    left = F.lit(b.requests) - used
    return F.when(exhausted | (place > left + 1), AFTER_BUDGET).when(place == left + 1, NO_REQUESTS).otherwise(intended)


def start(sites: DataFrame, b: Budgets) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state of the sites, frontier, dispositions of directives that are not queued) from robots captures.

    sites: site, robots (success, empty, transient or deterministic), robots_error (null or a safety reason), directives (array of URLs), root_allowed.
    """
    n = F.size("directives")
    fallback = (n == 0) & F.col("robots").isin("success", "empty") & F.col("robots_error").isNull()
    listed = F.when(fallback, F.array(F.concat("site", F.lit("/sitemap.xml")))).otherwise(F.col("directives"))
    s = sites.withColumn("listed", listed).withColumn("taken", F.least(F.size("listed"), F.lit(b.documents), F.lit(b.occurrences)))
    full = F.when(F.col("taken") >= b.documents, NO_DOCUMENTS).otherwise(NO_OCCURRENCES)
    cut = F.size("listed") > F.col("taken")
    failed = ~F.col("robots").isin("success", "empty")
    unsafe = F.col("robots_error").isNotNull() & ~failed
    state = s.select(
        "site", "robots", "root_allowed", unsafe.alias("stopped"), F.lit(False).alias("exhausted"),
        F.when(failed, 0).otherwise(F.col("taken")).cast("bigint").alias("u"), F.when(failed, 0).otherwise(F.col("taken")).cast("bigint").alias("d"),
        F.lit(1).cast("bigint").alias("r"), F.size("listed").cast("bigint").alias("n"),
        F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("digests"),
        F.array_compact(F.array(
            F.when(failed, F.struct(F.lit(0).cast("bigint").alias("at"), F.col("robots").alias("kind"), F.concat(F.lit("robots_"), "robots").alias("reason"))),
            F.when(cut & ~failed, _reason(TRUNCATION, full)), F.when(unsafe, _reason(SAFETY, F.col("robots_error"))),
        )).alias("reasons"),
    )
    every = s.where(~failed).select("site", "taken", unsafe.alias("unsafe"), full.alias("full"), F.posexplode("listed").alias("i", "url"))
    row = every.select("site", (F.col("i") + 1).cast("bigint").alias("q"), "url", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent_q"), (F.col("i") + 1).alias("entry"), "unsafe", (F.col("i") >= F.col("taken")).alias("over"), "full")
    frontier = row.where("NOT unsafe AND NOT over").drop("unsafe", "over", "full")
    rejected = row.where("unsafe OR over")
    intended = F.when(F.col("over"), F.col("full")).otherwise(AFTER_SAFETY)
    told = rejected.withColumn("told", _waiting(rejected, F.lit(1), F.lit(False), intended, b)).drop("unsafe", "over", "full")
    paid = told.groupBy("site").agg(F.count("*").alias("paid"))
    out_of = F.col("r") + F.coalesce("paid", F.lit(0)) > b.requests
    state = state.join(paid, "site", "left").withColumns({"exhausted": out_of, "stopped": F.col("stopped") | out_of, "r": F.least(F.lit(b.requests).cast("bigint"), F.col("r") + F.coalesce("paid", F.lit(0)))}).drop("paid")
    return _kept(state), _kept(frontier), _kept(told)


def level(frontier: DataFrame, state: DataFrame, documents: DataFrame, approved: DataFrame, b: Budgets) -> DataFrame:
    """The frontier's documents with dispositions, and what each takes of the budgets: one row each."""
    before = Window.partitionBy("site").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(column: Column) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    def earlier(column: Column) -> Column:
        return F.coalesce(F.collect_list(column).over(before), F.array().cast("array<string>"))

    x = frontier.join(state, "site").join(documents, "url", "left").join(approved.withColumn("approved", F.lit(True)), ["site", "origin"], "left")
    x = x.withColumns({"outcome": F.coalesce("outcome", F.lit("deterministic")), "requests": F.coalesce("requests", F.lit(1)), "allowed": F.coalesce("allowed", F.lit(True)), "approved": F.coalesce("approved", F.col("origin").isNull()), "final": F.coalesce("final_url", F.col("url"))})
    x = x.withColumn("gate", F.when(~F.col("approved"), BAD_ORIGIN).when(~F.col("allowed"), DISALLOWED))
    x = x.withColumn("known", F.concat("seen", earlier(F.col("url")), earlier(F.col("final"))))
    x = x.withColumns({"met": F.array_contains("known", F.col("url")), "post_final": F.array_contains("known", F.col("final"))})
    x = x.withColumn("fetched", F.col("gate").isNull() & ~F.col("met"))
    x = x.withColumn("same_url", F.col("met") & F.array_contains(F.concat("urls", earlier(F.when(F.col("fetched"), F.col("url")))), F.col("url")))
    ok = F.col("fetched") & (F.col("outcome") == "success")
    x = x.withColumn("same_digest", F.coalesce(ok & F.array_contains(F.concat("digests", earlier(F.when(ok, F.col("sha256")))), F.col("sha256")), F.lit(False)))
    told = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("same_url"), SAME_URL)
        .when(F.col("met") | F.col("post_final"), SAME_FINAL)
        .when(F.col("outcome") == "empty", EMPTY)
        .when(F.col("outcome") != "success", F.col("outcome"))
        .when(F.col("same_digest"), SAME_DIGEST)
        .when(F.col("root_type").isin(INDEX, URLSET), PARSED)
        .otherwise(F.coalesce("root_type", F.lit(SYNTAX)))
    )
    x = x.withColumn("told", told).withColumn("parsed", F.col("told") == PARSED).withColumn("is_index", F.col("parsed") & (F.col("root_type") == INDEX))
    x = x.withColumn("locs", F.when(F.col("parsed"), F.col("locations")).otherwise(F.array().cast(documents.schema["locations"].dataType))).withColumn("size", F.size("locs").cast("bigint"))
    # Places and budgets, as sums over the documents before.
    index_size = F.when(F.col("is_index"), F.col("size")).otherwise(0)
    x = x.withColumn("left_d", F.greatest(F.lit(0), F.lit(b.documents) - F.col("d") - ahead(index_size)))
    x = x.withColumn("by_d", F.when(F.col("is_index"), F.least("size", "left_d")).otherwise(F.col("size")))
    x = x.withColumn("wants_u", F.col("by_d") + (F.col("by_d") < F.col("size")).cast("bigint"))
    x = x.withColumn("left_u", F.greatest(F.lit(0), F.lit(b.occurrences) - F.col("u") - ahead(F.col("wants_u"))))
    x = x.withColumns({"taken": F.least("by_d", "left_u"), "uses_u": F.least("wants_u", "left_u")})
    x = x.withColumn("over", F.when(F.col("taken") < F.col("size"), F.when(F.col("taken") >= F.col("left_u"), NO_OCCURRENCES).otherwise(NO_DOCUMENTS)))
    x = x.withColumns({"uses_d": F.when(F.col("is_index"), F.col("taken")).otherwise(0), "uses_n": F.when(F.col("is_index"), F.col("taken") + F.col("over").isNotNull().cast("bigint")).otherwise(0)})
    x = x.withColumn("first_child", F.col("n") + ahead(F.col("uses_n")))
    # Requests: the fetch or the rejection, then the rejections of children that go no further.
    bad = F.transform(F.slice("locs", 1, F.greatest(F.col("taken"), F.lit(0)).cast("int")), lambda p: p["url"].isNull())
    x = x.withColumns({"own": F.when(F.col("fetched"), F.col("requests")).otherwise(1).cast("bigint"), "unsafe_at": F.array_position(bad, True)})
    x = x.withColumn("too_deep", F.col("is_index") & (F.col("depth") >= b.depth))
    from_ = F.when(F.col("too_deep"), 1).when(F.col("is_index") & (F.col("unsafe_at") > 0), F.col("unsafe_at"))
    x = x.withColumn("pays_from", from_)
    pays = F.coalesce(F.col("taken") - F.col("pays_from") + 1, F.lit(0)) + (F.col("is_index") & F.col("over").isNotNull()).cast("bigint")
    x = x.withColumn("pays", pays).withColumn("left_r", F.lit(b.requests) - F.col("r") - ahead(F.col("own") + F.col("pays")))
    x = x.withColumn("no_fetch", F.col("left_r") < F.col("own"))
    short = ~F.col("no_fetch") & (F.col("left_r") < F.col("own") + F.col("pays"))
    x = x.withColumn("short_at", F.when(short, F.coalesce(F.col("pays_from") + F.col("left_r") - F.col("own"), F.col("taken") + 1)))
    kind = F.when(F.col("gate").isNotNull() | (F.col("told") == SAFETY) | (~F.col("told").isin(PARSED, EMPTY, SAME_URL, SAME_FINAL, SAME_DIGEST, TRANSIENT, DETERMINISTIC, SYNTAX)), SAFETY).when(F.col("told") == TRANSIENT, TRANSIENT).when(F.col("told").isin(DETERMINISTIC, SYNTAX), DETERMINISTIC)
    x = x.withColumn("kind", kind)
    safe_stop = (F.col("kind") == SAFETY) | ((F.col("unsafe_at") > 0) & (F.col("short_at").isNull() | (F.col("unsafe_at") <= F.col("short_at"))))
    x = x.withColumns({"safety_stop": F.coalesce(~F.col("no_fetch") & safe_stop, F.lit(False)), "budget_stop": F.col("no_fetch") | F.col("short_at").isNotNull()})
    stop = F.min(F.when(F.col("safety_stop") | F.col("budget_stop"), F.col("q"))).over(Window.partitionBy("site"))
    x = x.withColumn("stop_q", stop).withColumn("behind", F.coalesce(F.col("q") > F.col("stop_q"), F.lit(False)))
    x = x.withColumn("told", F.when(F.col("no_fetch"), NO_REQUESTS).otherwise(F.col("told")))
    return x.drop("known", "locations", "final_url")


def diagnose(sites: DataFrame, documents: DataFrame, approved: DataFrame, page_allowed: Column, b: Budgets = Budgets()) -> Diagnosis:
    """Walks the sitemaps of all sites.

    sites: as for `start`. documents: url, origin, final_url, outcome (success, empty, transient, deterministic or safety), sha256, root_type (sitemapindex, urlset,
    or why it can't be parsed), locations (array of raw, url (null if malformed) and origin), requests, allowed (by its origin's robots file).
    approved: site, origin of allowed document origins. page_allowed: whether robots rules allow a location, over columns site and url. A document that was not captured is a
    deterministic failure.
    """
    state, frontier, told = start(sites, b)
    queue, entries, sums = [told], [], []
    for _ in range(b.depth + 1):
        live = state.where("NOT stopped").select("site", "u", "d", "r", "n", "urls", "seen", "digests")
        x = _kept(level(frontier, live, documents, approved, b))
        done = x.where("NOT behind")
        queue.append(done.select("site", "q", "url", "depth", "parent_q", "entry", "told"))
        at_stop = F.col("stop_q").eqNullSafe(F.col("q"))
        met = done.where("parsed AND NOT no_fetch").withColumn("shown", F.slice("locs", 1, (F.col("taken") + F.when(F.col("is_index") & F.col("over").isNotNull(), 1).otherwise(0)).cast("int")))
        e = met.select("site", "q", "depth", "is_index", "too_deep", "over", "taken", "unsafe_at", "short_at", "first_child", F.posexplode("shown").alias("i", "loc")).withColumn("entry", F.col("i") + 1)
        e = e.where("NOT is_index OR short_at IS NULL OR entry <= short_at")
        after = F.col("unsafe_at") > 0
        reason = (
            F.when(F.col("entry") == F.col("short_at"), NO_REQUESTS)
            .when(F.col("entry") > F.col("taken"), F.col("over"))
            .when(after & (F.col("entry") > F.col("unsafe_at")), AFTER_SAFETY)
            .when(F.col("loc.raw") == "", EMPTY_LOC)
            .when(F.col("loc.url").isNull(), MALFORMED_LOC)
            .when(F.col("too_deep"), NO_DEPTH)
            .when(F.col("is_index"), QUEUED)
            .otherwise(ACCEPTED)
        )
        e = _kept(e.select("site", "q", "entry", "depth", "is_index", F.coalesce("loc.url", "loc.raw").alias("url"), F.col("loc.origin").alias("origin"), reason.alias("told"), (F.col("first_child") + F.col("entry")).alias("child")))
        entries.append(e.where("NOT is_index"))
        kids = e.where("is_index").select("site", F.col("child").alias("q"), "url", (F.col("depth") + 1).alias("depth"), F.col("q").alias("parent_q"), "entry", "told")
        queue.append(kids.where(F.col("told") != QUEUED))
        next_ = kids.where(F.col("told") == QUEUED).drop("told")
        fine = ~F.col("no_fetch")
        reasons = _reasons(
            (F.col("kind").isNotNull() & fine & (F.col("kind") == SAFETY), SAFETY, F.col("told")), (fine & (F.col("kind") == TRANSIENT), TRANSIENT, F.lit("transient_failure")), (fine & (F.col("kind") == DETERMINISTIC), DETERMINISTIC, F.when(F.col("told") == SYNTAX, SYNTAX).otherwise("deterministic_failure")),
            (fine & (F.col("over") == NO_OCCURRENCES), TRUNCATION, F.lit(NO_OCCURRENCES)), (fine & F.col("is_index") & (F.col("over") == NO_DOCUMENTS), TRUNCATION, F.lit(NO_DOCUMENTS)),
            (fine & F.col("too_deep") & (F.col("taken") > 0), TRUNCATION, F.lit(NO_DEPTH)), (F.col("budget_stop"), TRUNCATION, F.lit(NO_REQUESTS)),
            (F.col("safety_stop") & (F.col("unsafe_at") > 0), SAFETY, F.when(F.get(F.col("locs"), (F.col("unsafe_at") - 1).cast("int"))["raw"] == "", EMPTY_LOC).otherwise(MALFORMED_LOC)),
        )
        spent = F.when(F.col("no_fetch"), F.greatest(F.col("left_r"), F.lit(0))).when(F.col("short_at").isNotNull(), F.col("left_r")).otherwise(F.col("own") + F.col("pays"))
        told_ok = F.col("fetched") & fine
        sums = done.groupBy("site").agg(
            F.sum(F.when(fine, F.col("uses_u"))).alias("du"), F.sum(F.when(fine, F.col("uses_d"))).alias("dd"), F.sum(spent).alias("dr"), F.sum(F.when(fine, F.col("uses_n"))).alias("dn"),
            F.bool_or(F.col("safety_stop") | F.col("budget_stop")).alias("now_stopped"), F.bool_or("budget_stop").alias("now_exhausted"), F.bool_or("safety_stop").alias("unsafe"),
            F.collect_list(F.when(told_ok, F.col("url"))).alias("more_urls"), F.flatten(F.collect_list(F.when(told_ok, F.array("url", "final")))).alias("more_seen"), F.collect_list(F.when(told_ok & (F.col("outcome") == "success"), F.col("sha256"))).alias("more_digests"),
            F.flatten(F.collect_list(reasons)).alias("more_reasons"),
        )
        merged = state.join(sums, "site", "left")
        state = _kept(merged.select(
            "site", "robots", "root_allowed", (F.col("stopped") | F.coalesce("now_stopped", F.lit(False))).alias("stopped"), (F.col("exhausted") | F.coalesce("now_exhausted", F.lit(False))).alias("exhausted"),
            *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0))).alias(c) for c in ("u", "d", "r", "n")],
            *[F.concat(c, F.coalesce(f"more_{c}", F.array().cast(merged.schema[c].dataType))).alias(c) for c in ("urls", "seen", "digests", "reasons")],
        ))
        waiting = x.where("behind").select("site", "q", "url", "depth", "parent_q", "entry").unionByName(next_.join(state.where("stopped"), "site", "left_semi"))
        waiting = waiting.join(state.select("site", "r", "exhausted", F.exists("reasons", lambda y: y["kind"] == SAFETY).alias("unsafe")), "site")
        held = waiting.withColumn("told", _waiting(waiting, F.col("r"), F.col("exhausted"), F.when(F.col("unsafe"), AFTER_SAFETY).otherwise(AFTER_BUDGET), b))
        queue.append(held.drop("r", "exhausted", "unsafe"))
        frontier = _kept(next_.join(state.where("stopped"), "site", "left_anti"))
        if frontier.isEmpty():
            break
    pages = _pages(_all(entries), page_allowed)
    return Diagnosis(_all(queue), pages, verdicts(state, pages))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pages(entries: DataFrame, page_allowed: Column) -> DataFrame:
    """Listed pages: other origins and disallowed ones are turned down, and of one page the first place is accepted."""
    judged = entries.withColumn("told", F.when(F.col("told") != ACCEPTED, F.col("told")).when(~F.col("origin").eqNullSafe(F.col("site")), CROSS_ORIGIN).when(~page_allowed, PAGE_DISALLOWED).otherwise(F.col("told")))
    fine = judged.where(F.col("told") == ACCEPTED)
    first = fine.groupBy("site", "url").agg(F.min(F.struct("q", "entry")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = F.col("first").isNotNull() & (F.struct("q", "entry") != F.col("first")) & (F.col("told") == ACCEPTED)
    return _kept(judged.join(first, ["site", "url"], "left").select("site", "q", "entry", "url", F.when(again, SAME_PAGE).otherwise(F.col("told")).alias("told")))


def verdicts(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Status, recommendation, priority, next action, reasons and use of the budgets of each site."""
    counts = pages.groupBy("site").agg(*[F.count_if(F.col("told") == t).alias(c) for t, c in ((ACCEPTED, "accepted"), (CROSS_ORIGIN, "crossed"), (PAGE_DISALLOWED, "disallowed"), (SAME_PAGE, "repeated"))])
    s = state.join(counts, "site", "left").na.fill(0, ["accepted", "crossed", "disallowed", "repeated"])

    def some(kind: str) -> Column:
        return F.exists("reasons", lambda y: y["kind"] == kind)

    answered = F.col("robots").isin("success", "empty")
    clean = ~some(TRUNCATION) & ~some(DETERMINISTIC)
    all_off = (F.col("disallowed") > 0) & (F.col("accepted") == 0)
    home_off = (F.col("accepted") == 0) & (F.col("crossed") == 0) & ~some(SAFETY) & clean & ~some(TRANSIENT) & answered & ~F.col("root_allowed")
    extra = F.array_compact(F.array(F.when(home_off, _reason(SAFETY, F.lit(HOME_DISALLOWED))), F.when(all_off, _reason(SAFETY, F.lit(ALL_DISALLOWED)))))
    s = s.withColumn("reasons", F.concat(F.sort_array("reasons"), extra))
    rank = (
        F.when(some(SAFETY), 1)
        .when(F.col("accepted") > 0, F.when(some(TRUNCATION) | some(TRANSIENT) | some(DETERMINISTIC), 2).otherwise(3))
        .when(some(TRANSIENT) & clean, 4)
        .when(answered & clean & ~some(TRANSIENT) & (F.col("crossed") == 0) & F.col("root_allowed"), 5)
        .otherwise(6)
    )
    # Status, recommendation and next action of each priority.
    ladder = {
        1: ("blocked", "operator_review", "resolve_safety_or_authority_error"),
        2: ("partial", "sitemap_seeded", "review_partial_sitemap_evidence"),
        3: ("complete", "sitemap_seeded", "submit_diagnostic_for_operator_review"),
        4: ("retryable", "retry_diagnosis", "retry_diagnosis"),
        5: ("complete", "bounded_homepage_fallback", "submit_bounded_homepage_fallback_for_operator_review"),
        6: ("blocked", "operator_review", "revise_inputs_or_boundaries_and_rediagnose"),
    }

    def of(i: int) -> Column:
        return F.create_map(*[F.lit(v) for k, row in ladder.items() for v in (k, row[i])])[F.col("priority")]

    def named(kind: str) -> Column:
        return F.transform(F.filter("reasons", lambda y: y["kind"] == kind), lambda y: y["reason"])

    ordered = F.array_distinct(F.concat(*map(named, (SAFETY, TRANSIENT, DETERMINISTIC, TRUNCATION))))
    return s.withColumn("priority", rank).select(
        "site", of(0).alias("status"), of(1).alias("recommendation"), "priority", of(2).alias("next_action"), ordered.alias("reasons"),
        F.col("r").alias("requests"), F.col("d").alias("documents"), F.col("u").alias("occurrences"), "accepted", "repeated", "crossed", "disallowed",
    )
