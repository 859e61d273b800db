"""Queries over site sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import sections, sources_of_files
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.views import sql_path, sql_segments


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of run 1, whose paths end in words of the sections, with the documents that they link; pages share some."""
    words = F.array(*map(F.lit, WORDS))
    s = views.snapshots(spark, sf_dir).where("run_id = 1")
    path = F.concat("path", F.lit("/"), F.get(words, F.col("page_id") % len(WORDS)))
    several = F.when(F.col("page_id") % 4 == 0, F.col("page_id") % 3).otherwise(F.lit(0)).cast("int")
    docs = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, several), lambda i: F.concat("site", F.lit("/files/"), ((F.col("page_id") + 4 * i) % 20).cast("string"), F.lit(".pdf")))
    return s.select(F.col("site"), F.concat("site", path).alias("url"), path.alias("path"), docs.alias("docs"))


#: Last segments that the views give to pages, so that all categories occur.
WORDS = ("research", "exam-req", "board", "budget", "member", "news", "archive", "about", "notes")
_LIST = ", ".join(f"'{w}'" for w in WORDS)
_PAGES = f"""{views.SNAPSHOTS}, p AS (
  SELECT site, site || path || '/' || [{_LIST}][page_id % {len(WORDS)} + 1] AS url, path || '/' || [{_LIST}][page_id % {len(WORDS)} + 1] AS path,
    list_transform(range(0, CASE WHEN page_id % 4 = 0 THEN page_id % 3 ELSE 0 END), lambda i: site || '/files/' || ((page_id + 4 * i) % 20) || '.pdf') AS docs FROM snapshots WHERE run_id = 1
)"""
_INVENTORY = f"""{_PAGES}, o AS (
  SELECT site, url, docs, unnest(list_transform(range(1, least(len({sql_segments('path')}), 3) + 1), lambda i: '/' || list_aggregate({sql_segments('path')}[1:i], 'string_agg', '/'))) AS section_path FROM p
), e AS (
  SELECT site, section_path, count(DISTINCT url) AS page_count, count(DISTINCT CASE WHEN len(docs) > 0 THEN url END) AS page_with_docs_count, len(list_distinct(flatten(list(docs)))) AS doc_link_count, min(url) AS sample_url,
    len({sql_segments('section_path')})::INT AS section_level FROM o GROUP BY ALL
), inv AS (
  SELECT e.*, coalesce(c.n, 0) AS child_section_count FROM e LEFT JOIN (SELECT site, regexp_extract(section_path, '^(.*)/[^/]*$', 1) AS parent, count(*) AS n FROM e WHERE section_level > 1 GROUP BY ALL) c ON c.site = e.site AND c.parent = e.section_path
)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.inventory(_pages(spark, sf_dir), "site", "url", "path", "docs")


@register(f"WITH {_INVENTORY} SELECT * FROM inv")
def section_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)


def _sql_cascade(table: tuple, text: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains({text}, '{t}')" for t in e[1])} THEN '{e[0]}'" for e in table)
    return f"CASE {cases} ELSE 'general_reference' END"


def _sql_level(field: int) -> str:
    cases = " ".join(f"WHEN '{e[0]}' THEN CASE WHEN doc_link_count > 0 THEN '{e[field][0]}' ELSE '{e[field][1]}' END" for e in sections.CLASSES)
    other = ("medium", "low") if field == 2 else ("low", "skip")
    return f"CASE source_category {cases} ELSE CASE WHEN doc_link_count > 0 THEN '{other[0]}' ELSE '{other[1]}' END END"


_CLASSIFIED = f"""{_INVENTORY}, t AS (SELECT *, lower(section_path || ' ' || {sql_path('sample_url')}) AS text FROM inv),
c1 AS (SELECT *, {_sql_cascade(sections.DISCOVERY, 'text')} AS candidate_category, {_sql_cascade(sections.CLASSES, 'text')} AS found FROM t),
c2 AS (SELECT *, CASE WHEN lower(section_path) = '/about' THEN 'general_reference' WHEN found = 'general_reference' THEN candidate_category ELSE found END AS source_category FROM c1),
classified AS (SELECT * EXCLUDE (text, found), {_sql_level(2)} AS business_importance, {_sql_level(3)} AS conversion_priority FROM c2)"""


@register(f"WITH {_CLASSIFIED} SELECT * FROM classified")
def section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (sections.rank(F.col("business_importance")), sections.rank(F.col("conversion_priority")), F.col("doc_link_count").desc(), F.col("page_count").desc(), F.col("section_path"), F.col("site"))
    return sections.classify(_inventory(spark, sf_dir)).orderBy(*order)


@register(
    f"""WITH {_CLASSIFIED}, labels AS (SELECT DISTINCT section_path, 'news_announcements' AS label FROM inv WHERE ends_with(section_path, 'notes'))
    SELECT c.site, c.section_path, coalesce(l.label, c.source_category) AS source_category FROM classified c LEFT JOIN labels l ON l.section_path = c.section_path"""
)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's labels take precedence."""
    rows = _inventory(spark, sf_dir)
    labels = rows.where(F.endswith("section_path", F.lit("notes"))).select("section_path", F.lit("news_announcements").alias("label_category")).distinct()
    return sections.classify(rows, labels).select("site", "section_path", "source_category")


@register(
    f"""WITH {_CLASSIFIED}, b AS (SELECT *, {views.sql_prefix('section_path', 2)} AS branch_path FROM classified WHERE section_level >= 2),
    tell AS (SELECT site, branch_path, source_category, count(*) AS n, min(section_path) AS first FROM b WHERE source_category NOT IN ('general_reference', 'archive_reference') GROUP BY ALL),
    dom AS (SELECT site, branch_path, arg_min(source_category, (-n, first)) AS dominant FROM tell GROUP BY ALL),
    sums AS (SELECT site, branch_path, count(*) FILTER (business_importance = 'high') AS n_high, count(*) FILTER (business_importance = 'medium') AS n_medium, count(*) FILTER (section_level = 3) AS sampled_level3_sections FROM b GROUP BY ALL),
    r AS (SELECT o.site, o.section_path AS branch_path, o.page_count, o.child_section_count, s.sampled_level3_sections, 0 AS skipped_candidate_pages, coalesce(d.dominant, o.source_category) AS dominant_category, o.business_importance AS own, n_high, n_medium
      FROM classified o JOIN sums s ON s.site = o.site AND s.branch_path = o.section_path LEFT JOIN dom d ON d.site = o.site AND d.branch_path = o.section_path WHERE o.section_level = 2)
    SELECT site, branch_path, page_count, child_section_count, sampled_level3_sections, skipped_candidate_pages, dominant_category,
      CASE WHEN dominant_category IN ('exam_education', 'governance_management') THEN 'low' WHEN dominant_category IN ('research_publications', 'finance_reports') AND n_high > 0 THEN 'high'
        WHEN dominant_category IN ('research_publications', 'finance_reports') AND (n_medium > 0 OR child_section_count > 0) THEN 'medium' WHEN dominant_category IN ('membership_operations', 'news_announcements') THEN 'low' ELSE own END AS business_importance,
      CASE WHEN dominant_category IN ('exam_education', 'governance_management') THEN 'low' WHEN sampled_level3_sections > 0 THEN 'medium' ELSE 'low' END AS expansion_priority FROM r"""
)
def branch_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.branches(sections.classify(_inventory(spark, sf_dir)), "site")


@register(f"WITH {_CLASSIFIED} SELECT site, source_category, count(*) AS n FROM classified GROUP BY ALL")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sections.histogram(sections.classify(_inventory(spark, sf_dir)), ["site"], "source_category")
    return counts.select("site", F.explode("counts").alias("source_category", "n"))


@register(
    f"""WITH {_PAGES}, r AS (SELECT site, url, {views.sql_prefix('path', 1)} AS branch, row_number() OVER (PARTITION BY site, {views.sql_prefix('path', 1)} ORDER BY url) AS n, count(*) OVER (PARTITION BY site, {views.sql_prefix('path', 1)}) AS total FROM p)
    SELECT site, branch, url, greatest(total - 2, 0) AS skipped_candidate_pages FROM r WHERE n <= 2"""
)
def section_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewake.functions import urls

    p = _pages(spark, sf_dir).select("site", "url", urls.path_prefix(F.col("path"), 1).alias("branch"))
    return sections.sample(p, ["site", "branch"], 2, F.col("url"))


@register(
    f"""WITH {_CLASSIFIED} SELECT section_level, sum(page_count)::BIGINT AS pages, count(*) AS n_sections, sum(doc_link_count)::BIGINT AS documents, count(DISTINCT site) AS n_sites FROM classified GROUP BY section_level"""
)
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.classify(_inventory(spark, sf_dir)).groupBy("section_level").agg(F.sum("page_count").alias("pages"), F.count("*").alias("n_sections"), F.sum("doc_link_count").alias("documents"), F.count_distinct("site").alias("n_sites"))


def _sql_source(field: int) -> str:
    def cases(table: tuple, text: str) -> str:
        def value(e: tuple) -> str:
            return f"'{e[0]}'" if field == 0 else f"CASE WHEN files >= {e[2]} THEN '{e[field][0]}' ELSE '{e[field][1]}' END"

        return " ".join(f"WHEN {' OR '.join(f"contains({text}, '{t}')" for t in e[1])} THEN {value(e)}" for e in table)

    return f"CASE {cases(sources_of_files.IN_URL_OR_TITLE, 'head')} {cases(sources_of_files.IN_EXCERPT, 'body')} ELSE '{'general_reference' if field == 0 else 'medium'}' END"


@register(f"WITH {_PAGES}, t AS (SELECT url, len(docs) AS files, lower({sql_path('url')} || ' ' || 'Title') AS head, CASE WHEN len(docs) > 0 THEN 'a journal of 1999' ELSE 'since 2001' END AS body FROM p) SELECT url, {_sql_source(0)} AS source_category, {_sql_source(3)} AS business_importance, {_sql_source(4)} AS conversion_priority FROM t")
def source_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("url", F.lit("Title").alias("title"), F.when(F.size("docs") > 0, "A Journal of 1999").otherwise("since 2001").alias("excerpt"), F.size("docs").cast("bigint").alias("files"))
    return sources_of_files.classify(p, "url", "title", "excerpt", "files").select("url", "source_category", "business_importance", "conversion_priority")
