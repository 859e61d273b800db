"""URL and path functions as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track a visit (fixed values), beside all that start with `utm_`.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Extensions of documents (fixed values).
DOCUMENT_TYPES = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt")

_SCHEME, _NETLOC, _PATH, _QUERY = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://",
    r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)",
    r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)",
    r"^[^?#]*\?([^#]*)",
)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(stripped(url), pattern, 1)


def form_decoded(text: Column) -> Column:
    """A part of a query: blanks for `+`, octets for escapes; a percent sign alone stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_encoded(text: Column) -> Column:
    """A part of a query: `+` for blanks, escapes for all but letters, digits and `_.-~`."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def escape_normal(text: Column, safe: str) -> Column:
    """Escapes of letters, digits and `-._~` decoded, others in upper case, and characters outside `safe` escaped."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    plain = F.lit(r"^[A-Za-z0-9._~-]$")

    def one(x: Column) -> Column:
        octet = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("bigint"))
        escape = F.when(F.rlike(octet, plain), octet).otherwise(F.upper(x))
        quoted = F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
        return F.when(F.length(x) == 3, escape).when(F.rlike(x, F.lit(safe)), x).otherwise(quoted)

    return F.array_join(F.transform(tokens, one), "")


def path_of(url: Column) -> Column:
    """The path of a URL, or the text itself if it has no scheme."""
    return part(url, _PATH)


def origin(url: Column) -> Column:
    """Lower-case scheme and host, with the port."""
    return F.lower(F.concat(part(url, _SCHEME), F.lit("://"), part(url, _NETLOC)))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, _NETLOC)), r"^.*@|:[0-9]+$", "")


def query_pairs(query: Column) -> Column:
    """(key, value) pairs of a query, decoded, sorted, without tracking keys; a key without `=` has an empty value."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(form_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), form_decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")),
    )
    kept = F.filter(pairs, lambda p: ~(F.startswith(F.lower(p["key"]), F.lit("utm_")) | F.lower(p["key"]).isin(*TRACKING_KEYS)))
    return F.array_sort(kept)


def request_url(url: Column) -> Column:
    """The URL to ask for: no tracking keys or fragment, sorted query, lower-case origin; empty if it isn't absolute."""
    pairs = F.array_join(F.transform(query_pairs(part(url, _QUERY)), lambda p: F.concat(form_encoded(p["key"]), F.lit("="), form_encoded(p["value"]))), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    whole = F.concat(origin(url), path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))
    return F.when((part(url, _SCHEME) != "") & (part(url, _NETLOC) != ""), whole).otherwise("")


def canonical_url(url: Column) -> Column:
    """The URL to track: as `request_url`, without slashes at the end of a path other than `/`."""
    asked = request_url(url)
    path = path_of(asked)
    bare = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = part(asked, _QUERY)
    return F.when(asked == "", "").otherwise(F.concat(origin(asked), bare, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def matches_prefixes(path: Column, prefixes: Column) -> Column:
    """Whether a path lies under one of an array of prefixes, by whole segments and whatever slashes end them; `/` holds all, no prefix none."""
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    return F.exists(prefixes, lambda p: (bare(p) == "") | (bare(path) == bare(p)) | F.startswith(bare(path), F.concat(bare(p), F.lit("/"))))


def joined(base: Column, ref: Column) -> Column:
    """A reference as an absolute URL, seen from a page: other schemes, `//host`, rooted, relative, `?query`, `#fragment`."""
    scheme, whole = part(base, _SCHEME), F.regexp_extract(stripped(base), "^([^#]*)", 1)
    at, bare = F.concat(scheme, F.lit("://"), part(base, _NETLOC)), F.regexp_extract(whole, r"^([^?]*)", 1)
    path, tail = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.regexp_replace(path_of(base), "[^/]*$", ""), path))
    last = F.rlike(rooted, F.lit(r"(^|/)\.{1,2}$"))  # a step at the end leaves its slash
    steps = F.aggregate(
        F.split(rooted, "/"),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    found = F.concat(F.array_join(steps, "/"), F.when(last, "/").otherwise(""))
    relative = F.concat(at, F.when(F.startswith(found, F.lit("/")), found).otherwise(F.concat(F.lit("/"), found)), tail)
    return (
        F.when(F.rlike(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), ref)
        .when(ref == "", stripped(base))
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(bare, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(whole, ref))
        .otherwise(relative)
    )


def in_scope(url: Column, allowed_origin: Column, prefixes: Column) -> Column:
    """Same origin, and a path under the prefixes."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return (origin(url) == allowed_origin) & matches_prefixes(path, prefixes)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_level(path: Column) -> Column:
    return F.size(segments(path))


def path_prefix(path: Column, level: int) -> Column:
    """The first segments, at most `level`; `/` at the root."""
    return F.concat(F.lit("/"), F.array_join(F.slice(segments(path), 1, level), "/"))


def section_prefixes(path: Column, depth: int) -> Column:
    """All ancestors of a path and itself, down to a depth; none for the root."""
    some = segments(path)
    upto = F.least(F.size(some), F.lit(depth))
    return F.when(upto > 0, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(some, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def normal_prefix(prefix: Column) -> Column:
    """Trimmed, with a slash before and none after; empty stays empty."""
    bare = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.trim(prefix), "^/+", "")), "/+$", "")
    return F.when(F.trim(prefix) == "", "").when(bare == "", "/").otherwise(bare)


def covers(prefix: Column, candidate: Column) -> Column:
    a, b = normal_prefix(prefix), normal_prefix(candidate)
    return (a != "") & (b != "") & ((a == "/") | (a == b) | F.startswith(b, F.concat(a, F.lit("/"))))


def domain_allowed(name: Column, domains: Sequence[str]) -> Column:
    """Whether a host is an allowed domain or below one; addresses only match exactly."""
    plain = F.regexp_replace(F.lower(name), r"\.$", "")
    is_address = F.rlike(plain, F.lit(r"^[0-9.]+$|:"))
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (plain == d) | (~is_address & F.endswith(plain, F.concat(F.lit("."), d))))


def redirect_allowed(old: Column, new: Column) -> Column:
    """Not from https to http."""
    return ~((F.lower(part(old, _SCHEME)) == "https") & (F.lower(part(new, _SCHEME)) == "http"))


def is_document(url: Column) -> Column:
    return F.rlike(F.lower(path_of(url)), F.lit(rf"\.({'|'.join(DOCUMENT_TYPES)})$"))


def slug(text: Column, empty: str) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", empty).otherwise(made)


def file_component(text: Column, longest: int = 80) -> Column:
    """A name that is safe as one component of a path."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), 1, longest)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def blob_path(sha256: Column, url: Column) -> Column:
    """Where content is kept: by the first two digits and the digest, with the URL's extension."""
    return F.concat(F.lit("_blobs/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, extension(path_of(url)))


def tracked_path(page_url: Column, file_url: Column, sha256: Column) -> Column:
    """A readable place for a file: host and path of the page, stem of the file, digits of the digest."""
    stem = F.regexp_extract(path_of(file_url), r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    page = F.array_join(F.transform(segments(path_of(page_url)), lambda s: file_component(s)), "/")
    return F.concat(F.lit("_tracked/"), host(page_url), F.when(page != "", F.concat(F.lit("/"), page)).otherwise(""), F.lit("/"), file_component(stem), F.lit("--"), F.substring(sha256, 1, 8), extension(path_of(file_url)))
