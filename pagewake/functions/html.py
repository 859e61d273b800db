"""Page normalisation, strict URLs and diffs: small row functions for what columns can't express."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Bytes of pages that are parsed at a time.
SLICE = 1 << 20
# Elements that hold no content, and hints of the content root.
NOISE = {"script", "style", "noscript", "template", "svg", "iframe", "form", "nav", "header", "footer", "aside"}
ROOTS = {"main", "article"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "br", *HEADINGS}


class Outline(HTMLParser):
    """Collects the blocks of a page as Markdown, by candidate root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.roots: list[dict] = [{"name": "body", "lines": [], "headings": [], "links": 0}]
        self.open: list[str] = []
        self.noise, self.text, self.mark, self.link = 0, "", "", ""

    def flush(self) -> None:
        line = " ".join(self.text.split())
        if line:
            for root in self.roots if self.open and any(t in ROOTS for t in self.open) else self.roots[:1]:
                root["lines"].append(self.mark + line)
                if self.mark.startswith("#"):
                    root["headings"].append(line)
        self.text, self.mark = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            self.mark = "#" * HEADINGS[tag] + " " if tag in HEADINGS else "- " if tag == "li" else ""
        if tag in NOISE:
            self.noise += 1
        if tag in ROOTS and not any(t in ROOTS for t in self.open):
            self.roots.append({"name": tag, "lines": [], "headings": [], "links": 0})
        if tag == "a" and not self.noise:
            self.link = dict(attrs).get("href") or ""
            for root in self.roots:
                root["links"] += 1
            self.text += "["
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "a" and not self.noise:
            self.text += f"]({self.link})"
        while self.open:
            last = self.open.pop()
            self.noise -= last in NOISE
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.noise and not {"title", "head"} & set(self.open):
            self.text += data

    def best(self) -> dict:
        """The root with the most words, links (80 at most) and headings; the first on ties."""
        self.flush()
        return max(self.roots, key=lambda r: sum(len(x.split()) for x in r["lines"]) + min(r["links"], 80) + 25 * len(r["headings"]) + (60 if r["name"] in ROOTS and r["lines"] else 0))


def outline(page: str | None) -> tuple[str, str, list[str], int, int, int]:
    """Text, Markdown, headings (10 at most), links, words and lines of a page."""
    parser = Outline()
    parser.feed(page or "")
    parser.close()
    root = parser.best()
    markdown = "\n\n".join(root["lines"])
    text = "\n".join(re.sub(r"^(#+|-) ", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", x)) for x in root["lines"])
    return text, markdown, root["headings"][:10], root["links"], len(text.split()), len(root["lines"])


def normalize(pages: DataFrame) -> DataFrame:
    """page_id, text, markdown, headings, n_links, n_words, n_lines of each page; a worker holds the results of SLICE bytes of pages at a time."""
    kinds = {"text": pa.string(), "markdown": pa.string(), "headings": pa.list_(pa.string()), "n_links": pa.int64(), "n_words": pa.int64(), "n_lines": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, SLICE):
            made = zip(*[outline(x.as_py()) for x in batch.column(1)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(made, kinds.values(), strict=True)]], ["page_id", *kinds])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, markdown string, headings array<string>, n_links bigint, n_words bigint, n_lines bigint")


def unified_diff(old: str, new: str, lines: int = 50) -> Column:
    """The first lines of the unified diff of two columns; a worker holds the lines of one pair at a time."""

    def one(a: str | None, b: str | None) -> str:
        return "\n".join(islice(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=3), lines))

    @F.arrow_udf("string")
    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((one(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)), pa.string())

    return differ(old, new)


UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def percent_normal(text: str) -> str:
    """Escapes in upper case; those of unreserved characters decoded."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c in UNRESERVED else f"%{m[1].upper()}"

    return re.sub(r"%([0-9A-Fa-f]{2})", one, text)


def without_dots(path: str) -> str:
    """RFC 3986, 5.2.4: `.` and `..` segments resolved."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def strict_url(url: str | None) -> str | None:
    """An absolute http(s) URL in normal form: ASCII host, no default port, dots or fragment; null if it can't be one."""
    m = re.fullmatch(r"(https?)://([^/?#@\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?", (url or "").strip(), re.I)
    if not m or re.search(r"[\x00-\x20\x7f]", url.strip()):
        return None
    name, _, port = m[2].partition(":")
    try:
        name = name.rstrip(".").encode("idna").decode().lower()
    except UnicodeError:
        return None
    scheme = m[1].lower()
    if port and not port.isdigit():
        return None
    port = f":{port}" if port and port != {"http": "80", "https": "443"}[scheme] else ""
    return f"{scheme}://{name}{port}{without_dots(percent_normal(m[3])) or '/'}" + (f"?{percent_normal(m[4])}" if m[4] is not None else "")


def normal_http_url(url: str) -> Column:
    """`strict_url` of a column."""

    @F.pandas_udf("string")
    def strict(u: pd.Series) -> pd.Series:
        return u.map(strict_url)

    return strict(url)
