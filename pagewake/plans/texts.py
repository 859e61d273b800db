"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import html, texts
from pagewake.plans.registry import register
from pagewake.sources.tables import table

_NORMAL = f"regexp_replace(regexp_replace(list_aggregate(list_transform(regexp_split_to_array(text, '{texts.LINE_END}'), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^[{texts.SPACE}]+|[{texts.SPACE}]+$', '', 'g')), 'string_agg', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


@register(f"SELECT doc_id, {_NORMAL} AS normal, sha256({_NORMAL}) AS content_hash FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.normal_text(F.col("text")).alias("normal"), texts.content_hash(F.col("text")).alias("content_hash"))


@register(
    """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n_words, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines,
    len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_tokens, substr(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 1, 160) AS title,
    substr(trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f]+', ' ', 'g')), 1, 700) AS excerpt,
    list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', chr(10) || chr(10)) AS markdown FROM documents"""
)
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        texts.word_count(t).cast("bigint").alias("n_words"),
        texts.line_count(t).cast("bigint").alias("n_lines"),
        texts.token_count(t).cast("bigint").alias("n_tokens"),
        texts.title(F.array().cast("array<string>"), t).alias("title"),
        texts.excerpt(t).alias("excerpt"),
        texts.as_markdown(t).alias("markdown"),
    )


@register("SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END) <> '' THEN 'fit_markdown' WHEN doc_id % 2 = 0 AND trim(lang) <> '' THEN 'markdown' ELSE 'content_text' END AS basis, CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END) <> '' THEN trim(text, chr(10) || chr(9) || ' ') WHEN doc_id % 2 = 0 AND trim(lang) <> '' THEN lang ELSE coalesce(source, '') END AS chosen FROM documents")
def compare_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, text = texts.compare_basis(("fit_markdown", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))), ("markdown", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), ("content_text", F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", basis.alias("basis"), text.alias("chosen"))


@register(
    """SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(authorization|bearer|token|secret|password|passwd|api[_-]?key)(\\s*[:=]\\s*)(\"?)[^\\s\"&]+', '\\1\\2\\3[REDACTED]', 'g'), '(?i)(https?://)[^/\\s@]+@', '\\1[REDACTED]@', 'g') AS redacted,
    CASE WHEN contains(lower(text), 'licensed') THEN 'Licensed' WHEN contains(lower(text), 'idiot') THEN 'idiot' END AS marker FROM documents"""
)
def text_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", texts.redacted(t).alias("redacted"), texts.blocked_marker(t, ["Licensed", "idiot"]).alias("marker"))


@register(
    """WITH m AS (SELECT page_id, page_id * 7 % 200 AS words, html || repeat('<script>', (page_id % 24)::INT) || ['', '__NEXT', 'gatsby', '<p id="root">'][page_id % 4 + 1] AS html FROM pages), t AS (SELECT *, lower(html) AS low, len(string_split(lower(html), '<script')) - 1 AS scripts FROM m)
    SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 256))), '^(<\\?xml|<rss|<feed|<urlset|<sitemapindex)') AS is_xml, list_filter([CASE WHEN contains(low, '__next') THEN 'nextjs' END, CASE WHEN contains(low, 'id="root"') OR contains(low, 'id=' || chr(39) || 'root' || chr(39)) OR contains(low, 'data-reactroot') THEN 'react-root' END,
    CASE WHEN contains(low, 'gatsby') THEN 'gatsby' END, CASE WHEN scripts >= 20 THEN 'scripts=' || scripts END, CASE WHEN words < 120 AND scripts >= 10 THEN 'low_text_high_script' END], lambda x: x IS NOT NULL) AS markers FROM t"""
)
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with up to 23 more scripts and some marks added."""
    by = F.col("page_id")
    mark = F.get(F.array(*map(F.lit, ("", "__NEXT", "gatsby", '<p id="root">'))), by % 4)
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.repeat(F.lit("<script>"), (by % 24).cast("int")), mark).alias("html"))
    return p.select("page_id", texts.looks_like_xml(F.col("html")).alias("is_xml"), texts.script_markers(F.col("html"), by * 7 % 200).alias("markers"))


@register("WITH t AS (SELECT page_id, url AS content FROM pages) SELECT page_id, CASE WHEN starts_with(content, '%PDF') THEN 'pdf' END AS kind, list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t JOIN pages USING (page_id)")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", texts.magic_type(F.col("url").cast("binary")).alias("kind"), texts.string_list(F.replace("url", F.lit("/"), F.lit(","))).alias("parts"))


@register()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised pages: text, Markdown, headings and counts of the content root."""
    return html.normalize(table(spark, sf_dir, "pages"))


@register()
def text_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of each page's Markdown between the runs, of pages that changed."""
    from pagewake.sources import views

    def markdown(run: int) -> DataFrame:
        return html.normalize(views.captures(spark, sf_dir).where(F.col("run_id") == run)).select("page_id", "markdown")

    new = markdown(2).select("page_id", F.concat("markdown", F.lit("\nlast line")).alias("new"))
    both = markdown(1).withColumnRenamed("markdown", "old").join(new, "page_id")
    return both.where(texts.content_hash(F.col("old")) != texts.content_hash(F.col("new"))).select("page_id", html.unified_diff("old", "new").alias("diff"))
