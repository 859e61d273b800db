"""Site sections: inventory, classification and branch priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.functions import urls

# For each category in order, the words that tell it, and its importance and conversion with and without documents.
DISCOVERY = (
    ("exam_education", ("exam-req", "/exam", "exams-admissions", "syllabus", "credential", "pass mark", "vee")),
    ("research_publications", ("research", "publication", "paper", "journal", "working-paper")),
    ("governance_management", ("governance", "board", "leadership", "election", "bylaws", "policy", "guideline", "committee", "council", "annual-report")),
    ("finance_reports", ("finance", "financial", "budget", "statement", "accounting", "audit")),
    ("membership_operations", ("membership", "member", "directory", "sponsorship", "advertising", "contact")),
    ("news_announcements", ("news", "article", "announcement", "press", "congress")),
)
CLASSES = (
    ("exam_education", ("exam-req", "/exam", "exam ", "syllabus", "candidate", "credential", "admissions", "education", "vee", "pass mark", "study note", "modules"), ("low", "low"), ("skip", "skip")),
    ("research_publications", ("research", "publication", "publications", "journal", "paper", "working paper", "monograph", "white paper", "research institute"), ("high", "high"), ("high", "medium")),
    ("governance_management", ("governance", "board", "leadership", "election", "elections", "policy", "policies", "guideline", "guidelines", "bylaws", "council", "committee", "annual-report", "annual reports", "governing", "statute"), ("low", "low"), ("skip", "skip")),
    ("finance_reports", ("finances", "finance", "financial", "budget", "budgets", "statement", "statements", "audited", "audit", "accounts", "treasury"), ("medium", "medium"), ("medium", "low")),
    ("membership_operations", ("membership", "member", "dues", "directory", "contact", "advertising", "sponsorship", "career"), ("low", "low"), ("low", "skip")),
    ("news_announcements", ("news", "announcement", "press", "event", "conference", "congress", "webinar", "calendar"), ("medium", "low"), ("low", "skip")),
    ("archive_reference", ("archive", "history", "historical", "past presidents", "past-president", "legacy"), ("low", "low"), ("skip", "skip")),
)
GENERAL = "general_reference"
HIGH_VALUE = ("research_publications", "finance_reports")
DEPRIORITIZED = ("exam_education", "governance_management")
RANK = {"high": 0, "medium": 1, "low": 2, "skip": 3}


def rank(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[level], F.lit(9))


def holds(text: Column, tokens: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(text, t))


def cascade(text: Column, table: Sequence[tuple], field: int = 0, other: str = GENERAL) -> Column:
    """The entry's field (0: the category) of the first class whose words the text holds."""
    out = F.lit(other)
    for entry in reversed(table):
        out = F.when(holds(text, entry[1]), entry[field]).otherwise(out)
    return out


def inventory(pages: DataFrame, site: str, url: str, path: str, docs: str, depth: int = 3) -> DataFrame:
    """A row for each site and section: level, pages, pages with documents, distinct documents, child sections, a sample.

    `docs` holds the URLs of the documents that the page links; a page counts for each section above it.
    """
    of = pages.select(site, url, F.col(docs).alias("_docs"), F.explode(urls.section_prefixes(F.col(path), depth)).alias("section_path"))
    linked = of.select(site, "section_path", F.explode("_docs").alias("doc")).distinct().groupBy(site, "section_path").agg(F.count("*").alias("doc_link_count"))
    each = of.groupBy(site, "section_path").agg(
        F.count_distinct(url).alias("page_count"),
        F.count_distinct(F.when(F.size("_docs") > 0, F.col(url))).alias("page_with_docs_count"),
        F.min(url).alias("sample_url"),
    )
    each = each.join(linked, [site, "section_path"], "left").withColumn("doc_link_count", F.coalesce("doc_link_count", F.lit(0)))
    each = each.withColumn("section_level", urls.path_level(F.col("section_path")))
    children = each.where("section_level > 1").withColumn("parent", F.regexp_extract("section_path", "^(.*)/[^/]*$", 1)).groupBy(site, F.col("parent").alias("section_path")).agg(F.count("*").alias("child_section_count"))
    return each.join(children, [site, "section_path"], "left").withColumn("child_section_count", F.coalesce("child_section_count", F.lit(0)))


def classify(sections: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Sections with candidate_category, source_category, business_importance and conversion_priority.

    A label (section_path, label_category) of a reviewer takes precedence over the words.
    """
    text = F.lower(F.concat_ws(" ", "section_path", urls.path_of(F.col("sample_url"))))
    has_docs = F.col("doc_link_count") > 0
    out = sections.withColumn("candidate_category", cascade(text, DISCOVERY)).withColumn("_found", cascade(text, CLASSES))
    found = F.when(F.lower("section_path") == "/about", GENERAL).when(F.col("_found") == GENERAL, F.col("candidate_category")).otherwise(F.col("_found"))
    if labels is not None:
        out = out.join(labels, "section_path", "left")
        found = F.coalesce("label_category", found)
    out = out.withColumn("source_category", found)
    importance, conversion = F.when(has_docs, "medium").otherwise("low"), F.when(has_docs, "low").otherwise("skip")
    for name, _, (imp_docs, imp), (conv_docs, conv) in CLASSES:
        here = F.col("source_category") == name
        importance = F.when(here, F.when(has_docs, imp_docs).otherwise(imp)).otherwise(importance)
        conversion = F.when(here, F.when(has_docs, conv_docs).otherwise(conv)).otherwise(conversion)
    return out.withColumn("business_importance", importance).withColumn("conversion_priority", conversion).drop("_found")


def branches(classified: DataFrame, site: str, skipped: DataFrame | None = None) -> DataFrame:
    """Priorities of second-level branches: dominant category, importance and priority of expansion.

    A section belongs to the branch of its first two segments, so descendants meet their branch
    by an equi-join. Of categories that are as frequent, the one first in path order dominates.
    """
    below = classified.where("section_level >= 2").withColumn("branch_path", urls.path_prefix(F.col("section_path"), 2))
    telling = below.where(~F.col("source_category").isin(GENERAL, "archive_reference")).groupBy(site, "branch_path", "source_category").agg(F.count("*").alias("n"), F.min("section_path").alias("first"))
    dominant = telling.groupBy(site, "branch_path").agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "source_category"))["source_category"].alias("dominant"))
    sums = below.groupBy(site, "branch_path").agg(
        F.count_if(F.col("business_importance") == "high").alias("n_high"),
        F.count_if(F.col("business_importance") == "medium").alias("n_medium"),
        F.count_if(F.col("section_level") == 3).alias("sampled_level3_sections"),
    )
    own = classified.where("section_level = 2").withColumnRenamed("section_path", "branch_path")
    rows = own.join(sums, [site, "branch_path"]).join(dominant, [site, "branch_path"], "left")
    rows = rows.join(skipped, [site, "branch_path"], "left") if skipped is not None else rows.withColumn("skipped_candidate_pages", F.lit(0))
    rows = rows.withColumn("skipped_candidate_pages", F.coalesce("skipped_candidate_pages", F.lit(0))).withColumn("dominant_category", F.coalesce("dominant", "source_category"))
    d, skips = F.col("dominant_category"), F.col("skipped_candidate_pages")
    importance = (
        F.when(d.isin(*DEPRIORITIZED), "low")
        .when(d.isin(*HIGH_VALUE) & ((F.col("n_high") > 0) | (skips >= 10)), "high")
        .when(d.isin(*HIGH_VALUE) & ((F.col("n_medium") > 0) | (F.col("child_section_count") > 0)), "medium")
        .when(d.isin("membership_operations", "news_announcements") & (skips == 0), "low")
        .otherwise(F.col("business_importance"))
    )
    expansion = F.when(d.isin(*DEPRIORITIZED), "low").when(d.isin(*HIGH_VALUE) & (skips >= 20), "high").when((skips > 0) | (F.col("sampled_level3_sections") > 0), "medium").otherwise("low")
    return rows.select(site, "branch_path", "page_count", "child_section_count", "sampled_level3_sections", "skipped_candidate_pages", "dominant_category", importance.alias("business_importance"), expansion.alias("expansion_priority"))


def histogram(rows: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """A map of category counts for each key."""
    counted = rows.groupBy(*by, category).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("counts"))


def sample(pages: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, and of each how many are left out."""
    ranked = pages.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    left = pages.groupBy(*by).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("skipped_candidate_pages"))
    return ranked.where(F.col("_n") <= k).drop("_n").join(left, list(by))
