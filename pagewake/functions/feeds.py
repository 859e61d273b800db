"""Feeds, sitemaps and nested values: small row functions over text columns."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewake.functions.texts import redacted

#: Entries that a listing of a feed or of a sitemap shows (fixed values).
FEED_ITEMS, SITEMAP_ITEMS = 100, 500
SECRET_KEYS = ("authorization", "apikey", "token", "secret", "password", "passwd", "cookie", "credential", "signature")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def listing(xml: str | None) -> tuple[str, str, int]:
    """Kind (feed, sitemap, xml or invalid), Markdown list of links or text, and number of entries of an XML text.

    Texts with a document type or entity declaration are invalid: nothing in them is expanded.
    """
    if not xml or re.search(r"<!(DOCTYPE|ENTITY)", xml, re.I):
        return "invalid", "", 0
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return "invalid", "", 0
    kind = _local(root.tag)
    if kind in ("urlset", "sitemapindex"):
        places = [(e.text or "").strip() for e in root.iter() if _local(e.tag) == "loc" and (e.text or "").strip()]
        return "sitemap", "\n".join(f"- {p}" for p in places[:SITEMAP_ITEMS]), len(places)
    if kind in ("rss", "feed", "rdf"):
        lines = []
        for item in (e for e in root.iter() if _local(e.tag) in ("item", "entry")):
            fields = {_local(e.tag): (e.text or "").strip() or e.get("href", "") for e in item}
            lines.append(f"- [{fields.get('title', '') or fields.get('link', '')}]({fields.get('link', '')})")
        return "feed", "\n".join(lines[:FEED_ITEMS]), len(lines)
    return "xml", " ".join(" ".join(root.itertext()).split()), 0


def listed(xml: str) -> Column:
    """`listing` of a column, as a struct of kind, markdown and entries."""

    @F.pandas_udf("kind string, markdown string, entries int")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([listing(v) for v in x], columns=["kind", "markdown", "entries"])

    return run(xml)


def is_secret_key(key: str) -> bool:
    plain = re.sub(r"[^a-z0-9]", "", key.casefold())
    return any(s in plain for s in SECRET_KEYS)


def _masked(value: object) -> object:
    if isinstance(value, dict):
        return {k: "[REDACTED]" if is_secret_key(k) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


def masked_json(text: str | None) -> str | None:
    """A JSON text with the values of secret keys masked at all depths; null if it is no JSON."""
    try:
        return json.dumps(_masked(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return None


def redacted_json(column: str) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(masked_json)

    return run(column)


def redacted_url(url: Column) -> Column:
    """A URL without user information, values of secret query keys masked."""
    keys = "|".join(SECRET_KEYS)
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(bare, rf"(?i)([?&#][^=&#]*(?:{keys})[^=&#]*=)[^&#]*", "$1[REDACTED]")


def diagnostic_text(text: Column, longest: int = 4096) -> Column:
    """Redacted text with paths of the host masked, of bounded length."""
    return F.substring(F.regexp_replace(redacted(text), r"(?:/(?:home|root|tmp|var)|[A-Z]:\\)[^\s\"']*", "[PATH]"), 1, longest)
