"""Captured files as bytes: decoding with typed errors, agreement of header, name and content, and replay of stored observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MIME types with the extensions that agree with them.
EXTENSIONS = {
    "text/html": ("html", "htm"),
    "application/xhtml+xml": ("xhtml", "html", "htm"),
    "application/pdf": ("pdf",),
    "application/zip": ("zip",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("docx",),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("xlsx",),
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ("pptx",),
    "application/msword": ("doc",),
    "application/vnd.ms-excel": ("xls",),
    "application/vnd.ms-powerpoint": ("ppt",),
    "application/json": ("json",),
    "application/xml": ("xml",),
    "text/xml": ("xml",),
    "text/plain": ("txt",),
    "text/markdown": ("md", "markdown"),
    "image/png": ("png",),
    "image/jpeg": ("jpg", "jpeg"),
    "image/gif": ("gif",),
}
# What the first bytes of a type are, in hexadecimal digits.
FIRST = {
    "application/pdf": ("255044462D",),
    "application/msword": ("D0CF11E0A1B11AE1",),
    "application/vnd.ms-excel": ("D0CF11E0A1B11AE1",),
    "application/vnd.ms-powerpoint": ("D0CF11E0A1B11AE1",),
    "image/png": ("89504E470D0A1A0A",),
    "image/jpeg": ("FFD8FF",),
    "image/gif": ("474946383761", "474946383961"),
}
ARCHIVE = ("504B0304", "504B0506", "504B0708")
# Archives, and the name of the part that each kind holds.
PARTS = {
    "application/zip": "",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word/",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xl/",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "ppt/",
}
NO_TEXT, NOT_BASE64, OTHER_DIGEST = "content_missing", "invalid_base64", "sha256_mismatch"
BLOBS = "_blobs"


def decoded(text: Column, representation: Column, scope: Column, sha256: Column) -> Column:
    """Struct of payload (binary), sha256 and error of a captured file.

    Base64 counts as such only if the capture says so and gives the digest of the decoded bytes; other text is taken as UTF-8. A digest that is given must be
    the payload's. No error ends the job: it becomes a value, with a null payload.
    """
    said = F.coalesce((representation == "base64") & (scope == "decoded-bytes") & sha256.isNotNull(), F.lit(False))
    payload = F.when(said, F.when(F.rlike(text, F.lit(r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")), F.try_to_binary(text, F.lit("base64")))).otherwise(F.encode(text, "UTF-8"))
    digest = F.sha2(payload, 256)
    error = F.when(text.isNull(), NO_TEXT).when(payload.isNull(), NOT_BASE64).when(sha256 != digest, OTHER_DIGEST)
    return F.struct(F.when(error.isNull(), payload).alias("payload"), F.when(error.isNull(), digest).alias("sha256"), error.alias("error"))


def basename(url: Column) -> Column:
    """The last segment of a URL's path, or `document`."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("document"))


def suffix(name: Column, gzip: Column | None = None) -> Column:
    """The last extension of a file's name, lower-cased and without its dot; before a `gz` that gzip as transfer explains."""
    bare = F.regexp_replace(name, r"^\.++", "")
    parts = F.when(F.endswith(bare, F.lit(".")), F.array().cast("array<string>")).otherwise(F.slice(F.split(F.lower(bare), r"\."), 2, 1 << 20))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    if gzip is None:
        return last
    return F.when(gzip & (last == "gz"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).otherwise(last)


def guessed(content_type: Column) -> Column:
    """The first extension of a MIME type; empty if it is unknown."""
    bare = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    table = F.create_map(*[F.lit(v) for mime, names in EXTENSIONS.items() for v in (mime, names[0])])
    return F.coalesce(F.try_element_at(table, bare), F.lit(""))


def document(url: Column, content_type: Column, file: Column) -> Column:
    """Struct of title, doc_type, blob_path and file_size of a decoded file; its extension is that of its URL, or else of its type."""
    title = basename(url)
    kind = F.coalesce(F.nullif(suffix(title), F.lit("")), guessed(content_type), F.lit(""))
    path = F.concat_ws("/", F.lit(BLOBS), F.substring(file["sha256"], 1, 2), F.concat(file["sha256"], F.when(kind != "", F.concat(F.lit("."), kind)).otherwise("")))
    fine = file["error"].isNull()
    return F.struct(*[F.when(fine, v).alias(n) for n, v in (("title", title), ("doc_type", kind), ("blob_path", path), ("file_size", F.octet_length(file["payload"]).cast("bigint")))])


def _starts(data: Column, digits: tuple[str, ...]) -> Column:
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit(False)
    for d in digits:
        out = out | F.startswith(head, F.lit(d))
    return out


def content_agrees(mime: Column, data: Column) -> Column:
    """Whether bytes look like their MIME type."""
    head = F.regexp_replace(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), "^[ï»¿\\x00\\x09\\x0a\\x0c\\x0d\\x20]++", "")
    text = F.try_validate_utf8(data.cast("string"))
    out = F.lit(False)
    for kind, digits in FIRST.items():
        out = F.when(mime == kind, _starts(data, digits)).otherwise(out)
    for kind, part in PARTS.items():
        out = F.when(mime == kind, _starts(data, ARCHIVE) & F.contains(data, F.encode(F.lit(part), "UTF-8"))).otherwise(out)
    out = F.when(mime.isin("text/html", "application/xhtml+xml"), F.rlike(head, F.lit(r"(?i)<(?:!doctype\s+html\b|html\b|head\b|body\b)"))).otherwise(out)
    out = F.when(mime.isin("application/xml", "text/xml"), F.startswith(head, F.lit("<"))).otherwise(out)
    out = F.when(mime == "application/json", text.isNotNull() & F.try_parse_json(text).isNotNull()).otherwise(out)
    return F.coalesce(F.when(mime.isin("text/plain", "text/markdown"), text.isNotNull() & ~F.contains(data, F.unhex(F.lit("00")))).otherwise(out), F.lit(False))


def mime_check(header: Column, data: Column, name: Column, encoding: Column, allowed: tuple[str, ...] = tuple(EXTENSIONS)) -> Column:
    """Struct of mime_type and error: header, then support, then the extension of a name or URL, then the content must agree. No extension agrees with all."""
    mime = F.lower(F.trim(F.substring_index(header, ";", 1)))
    path = F.when(F.contains(name, F.lit("://")), F.try_url_decode(F.regexp_extract(name, r"^[^:]*://[^/?#]*([^?#]*)", 1))).otherwise(name)
    ext = suffix(F.substring_index(path, "/", -1), encoding == "gzip")
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for m in allowed for x in (m, EXTENSIONS[m])])
    fits = (ext == "") | F.array_contains(F.coalesce(F.try_element_at(known, mime), F.array().cast("array<string>")), ext)
    error = (
        F.when(header.isNull() | (F.trim(header) == ""), "mime.header_missing")
        .when(~mime.isin(*allowed), "mime.unsupported")
        .when(~F.coalesce(fits, F.lit(True)), "mime.extension_mismatch")
        .when(~content_agrees(mime, data), "mime.magic_mismatch")
    )
    return F.struct(F.when(error.isNull(), mime).alias("mime_type"), error.alias("error"))


def replay(observations: DataFrame, versions: DataFrame, blobs: DataFrame, asked: DataFrame) -> DataFrame:
    """artifact_id, version_id, payload, error of the asked observations, a row each.

    observations: artifact_id, version_id, sha256, size_bytes. versions: version_id. blobs: sha256, payload. An observation that isn't there, a version or blob that it refers to
    in vain, and bytes of another size or digest are errors of its row.
    """
    o = asked.select("artifact_id").distinct().join(observations.withColumn("has", F.lit(True)), "artifact_id", "left")
    x = o.join(versions.select("version_id", F.lit(True).alias("versioned")), "version_id", "left").join(blobs.select("sha256", "payload", F.lit(True).alias("stored")), "sha256", "left")
    error = (
        F.when(F.col("has").isNull(), "observation.not_found")
        .when(F.col("versioned").isNull() | F.col("stored").isNull(), "reference.dangling")
        .when(F.coalesce((F.octet_length("payload") != F.col("size_bytes")) | (F.sha2("payload", 256) != F.col("sha256")), F.lit(True)), "blob.corrupt")
    )
    return x.select("artifact_id", "version_id", F.when(error.isNull(), F.col("payload")).alias("payload"), error.alias("error"))
