"""Queries over captured files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import blobs
from pagewake.plans.registry import register
from pagewake.sources.tables import table

_TYPES = ("application/pdf", "text/plain; charset=utf-8", "Text/HTML", "image/x-unknown")
_URLS = ("/files/{}.PDF?v=1", "/files/{}", "/{}.tar.gz", "/")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


@register(
    """WITH c AS (SELECT doc_id, text, doc_id % 9 AS k, ['application/pdf', 'text/plain; charset=utf-8', 'Text/HTML', 'image/x-unknown'][doc_id % 4 + 1] AS type, doc_id % 5 AS u FROM documents),
    e AS (SELECT *, CASE k WHEN 1 THEN 'content_missing' WHEN 2 THEN 'invalid_base64' WHEN 3 THEN 'sha256_mismatch' WHEN 4 THEN 'sha256_mismatch' END AS error, sha256(text) AS sha,
      CASE u WHEN 0 THEN doc_id || '.PDF' WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN doc_id || '.tar.gz' WHEN 3 THEN 'document' ELSE '.hidden' END AS title FROM c),
    t AS (SELECT *, CASE u WHEN 0 THEN 'pdf' WHEN 2 THEN 'gz' ELSE CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'html' ELSE '' END END AS doc_type FROM e)
    SELECT doc_id, error, CASE WHEN error IS NULL THEN sha END AS sha256, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN doc_type END AS doc_type,
      CASE WHEN error IS NULL THEN '_blobs/' || sha[1:2] || '/' || sha || CASE WHEN doc_type <> '' THEN '.' || doc_type ELSE '' END END AS blob_path, CASE WHEN error IS NULL THEN strlen(text) END AS file_size FROM t"""
)
def captured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from captures, most as Base64; by its number a capture lacks its text, is no Base64, or has another digest."""
    d = table(spark, sf_dir, "documents")
    k, u, key = F.col("doc_id") % 9, F.col("doc_id") % 5, F.col("doc_id").cast("string")
    encoded = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    content = F.when(k == 1, None).when(k == 2, F.concat(encoded, F.lit("!"))).when(k.isin(4, 5, 6), F.col("text")).otherwise(encoded)
    sha = F.when(k.isin(3, 4), F.lit("0" * 64)).when(k == 6, None).otherwise(F.sha2("text", 256))
    url = F.concat(F.lit("https://files.example.org/a/"), F.when(u == 0, F.concat(key, F.lit(".PDF?v=1"))).when(u == 1, key).when(u == 2, F.concat(key, F.lit(".tar.gz#p"))).when(u == 3, "").otherwise(".hidden"))
    made = d.select("doc_id", url.alias("url"), _pick(_TYPES, F.col("doc_id")).alias("type"), blobs.decoded(content, F.when(k.isin(4, 5), "text").otherwise("base64"), F.lit("decoded-bytes"), sha).alias("file"))
    return made.select("doc_id", "file.error", "file.sha256", blobs.document(F.col("url"), F.col("type"), F.col("file")).alias("d")).select("doc_id", "error", "sha256", "d.*")


_HEADERS = ("Text/HTML; charset=utf-8", "application/pdf", "text/plain", "application/json", "image/png", "", "text/css", "application/xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


@register(
    """WITH p AS (SELECT page_id, html, page_id % 9 AS h, page_id % 7 AS b, page_id % 5 AS n FROM pages), m AS (
      SELECT *, ['text/html', 'application/pdf', 'text/plain', 'application/json', 'image/png', '', 'text/css', 'application/xml', 'docx'][h + 1] AS mime, CASE n WHEN 0 THEN '' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'txt' ELSE 'json' END AS ext FROM p
    ), e AS (SELECT *, CASE WHEN h = 5 THEN 'mime.header_missing' WHEN h = 6 THEN 'mime.unsupported'
        WHEN ext <> '' AND NOT ((mime = 'text/html' AND ext = 'html') OR (mime = 'application/pdf' AND ext = 'pdf') OR (mime = 'text/plain' AND ext = 'txt') OR (mime = 'application/json' AND ext = 'json')) THEN 'mime.extension_mismatch'
        WHEN NOT (CASE b WHEN 0 THEN (mime IN ('text/html', 'application/xml') AND starts_with(ltrim(html), '<') AND (mime <> 'text/html' OR regexp_matches(lower(html[1:4096]), '<(!doctype\\s+html\\b|html\\b|head\\b|body\\b)'))) OR mime = 'text/plain'
          WHEN 1 THEN mime IN ('application/pdf', 'text/plain') WHEN 2 THEN mime = 'text/plain' WHEN 3 THEN mime IN ('application/json', 'text/plain') WHEN 4 THEN mime = 'image/png' OR (mime = 'text/html' AND regexp_matches(lower(html[1:4087]), '<(!doctype\\s+html\\b|html\\b|head\\b|body\\b)')) WHEN 5 THEN false ELSE mime = 'docx' END) THEN 'mime.magic_mismatch' END AS error FROM m)
    SELECT page_id, CASE WHEN error IS NULL THEN CASE mime WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE mime END END AS mime_type, error FROM e"""
)
def mime_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under several headers and names, as themselves, after a PDF's mark, as words, JSON, a picture, bytes that are no text, and an archive."""
    b, n, key = F.col("page_id") % 7, F.col("page_id") % 5, F.col("page_id").cast("string")
    html, hexed = F.encode("html", "UTF-8"), lambda digits: F.unhex(F.lit(digits))
    data = (
        F.when(b == 0, html).when(b == 1, F.encode(F.concat(F.lit("%PDF-1.7 "), key), "UTF-8")).when(b == 2, F.encode(F.concat(F.lit("words "), key), "UTF-8")).when(b == 3, F.encode(F.concat(F.lit('{"page": ['), key, F.lit("]}")), "UTF-8"))
        .when(b == 4, F.concat(hexed("89504E470D0A1A0A00"), html)).when(b == 5, hexed("00FFFE")).otherwise(F.concat(hexed("504B030400"), F.encode(F.lit("word/document.xml"), "UTF-8")))
    )
    name = F.when(n == 0, F.concat(F.lit("https://a.org/x.y/"), key)).when(n == 1, F.concat(F.lit("https://a.org/"), key, F.lit("%2Ehtml?x=.pdf"))).when(n == 2, F.concat(key, F.lit(".PDF"))).when(n == 3, F.concat(key, F.lit(".txt.gz"))).otherwise("a.b.json")
    p = table(spark, sf_dir, "pages").select("page_id", _pick(_HEADERS, F.col("page_id")).alias("header"), data.alias("data"), name.alias("name"), F.when(n == 3, "gzip").otherwise("identity").alias("encoding"))
    return p.select("page_id", blobs.mime_check(*map(F.col, ("header", "data", "name", "encoding"))).alias("m")).select("page_id", "m.*")


@register(
    """WITH o AS (SELECT doc_id AS id, text, doc_id % 10 AS k, sha256(text) AS sha FROM documents), gone AS (SELECT DISTINCT sha FROM o WHERE k = 3), bad AS (SELECT DISTINCT sha FROM o WHERE k = 4 AND sha NOT IN (SELECT sha FROM gone))
    SELECT 'a' || id AS artifact_id, CASE WHEN k <> 1 THEN 'v' || id END AS version_id, CASE WHEN k <> 1 AND k <> 2 AND sha NOT IN (SELECT sha FROM gone) AND sha NOT IN (SELECT sha FROM bad) AND k <> 5 THEN sha END AS sha256,
      CASE WHEN k = 1 THEN 'observation.not_found' WHEN k = 2 OR sha IN (SELECT sha FROM gone) THEN 'reference.dangling' WHEN sha IN (SELECT sha FROM bad) OR k = 5 THEN 'blob.corrupt' END AS error FROM o"""
)
def replayed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files replayed; some observations, versions and blobs are gone, some blobs have other bytes, some observations another size."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("artifact_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"), F.encode("text", "UTF-8").alias("payload"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 10).alias("k"))
    size = F.octet_length("payload").cast("bigint") + F.when(F.col("k") == 5, 1).otherwise(0)
    observations = d.where("k <> 1").select("artifact_id", "version_id", "sha256", size.alias("size_bytes"))
    kept = d.groupBy("sha256").agg(F.bool_or(F.col("k") == 3).alias("gone"), F.bool_or(F.col("k") == 4).alias("bad"), F.min("payload").alias("payload")).where("NOT gone")
    stored = kept.select("sha256", F.when(F.col("bad"), F.concat("payload", F.unhex(F.lit("00")))).otherwise(F.col("payload")).alias("payload"))
    found = blobs.replay(observations, d.where("k <> 2").select("version_id"), stored, d)
    return found.select("artifact_id", "version_id", F.sha2("payload", 256).alias("sha256"), "error")
