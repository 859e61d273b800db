"""Text functions as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewake.functions import urls

#: White space and line ends of texts.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
NOISE = r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>"


def normal_text(text: Column) -> Column:
    """Line ends unified, blanks in lines collapsed, white space at their ends gone, runs of blank lines made one, none at either end."""
    lines = F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the normal text; an empty text has the digest of the empty string."""
    return F.sha2(normal_text(text), 256)


def compare_basis(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """Name and text, without white space at its ends, of the first choice that isn't blank; else the last choice as it is."""
    basis, text = F.lit(choices[-1][0]), F.coalesce(choices[-1][1], F.lit(""))
    for name, value in reversed(choices[:-1]):
        bare = F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")
        basis, text = (F.when(bare != "", a).otherwise(b) for a, b in ((F.lit(name), basis), (bare, text)))
    return basis, text


def unescaped(value: Column) -> Column:
    """A value of an attribute or of an XML text: the character references that URLs hold decoded."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def attribute(value: Column) -> Column:
    return unescaped(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def without_comments(html: Column) -> Column:
    """Comments removed; one that isn't closed is none. Only what lies before the last end of a comment is searched, so each search ends soon."""
    tail = F.substring_index(html, "-->", -1)
    head = F.substr(html, F.lit(1), F.length(html) - F.length(tail))
    return F.when(F.contains(html, F.lit("-->")), F.concat(F.regexp_replace(head, r"(?s)<!--.*?-->", ""), tail)).otherwise(html)


#: An anchor's tag up to its end or that of the text, and its `href`; possessive, so neither goes back nor deep.
ANCHOR = r"""(?is)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
HREF = r"""(?is)^<a\s(?:(?!(?<=[\s"'])href\s*+=)(?:[^"']|"[^"]*+"|'[^']*+'))*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)"""


def links(html: Column) -> Column:
    """The `href` values of anchors, however quoted, in page order; comments hold none. Time is linear in the text."""
    tags = F.regexp_extract_all(without_comments(html), F.lit(ANCHOR), F.lit(0))
    found = F.filter(F.transform(tags, lambda x: F.regexp_extract(x, HREF, 1)), lambda x: x != "")
    return F.transform(found, lambda x: urls.stripped(attribute(x)))


def feed_links(xml: Column) -> Column:
    """Texts of `loc`, and texts or `href` values of `link`, of a sitemap or feed."""
    loc, text = (F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w++:)?{tag}(?:\s[^<>]*+)?>([^<]*+)(?=<)"), F.lit(1)) for tag in ("loc", "link"))
    href = F.regexp_extract_all(xml, F.lit(r"""(?s)<(?:\w++:)?link\s(?:[^<>]*?\s)?href\s*+=\s*+("[^"]*+"|'[^']*+')"""), F.lit(1))
    return F.concat(F.transform(F.concat(loc, text), lambda x: urls.stripped(unescaped(x))), F.transform(href, attribute))


def absolute_links(html: Column, page: Column) -> Column:
    """Sorted distinct http(s) links of a page, seen from its URL, or of a sitemap or feed."""
    head = F.lower(F.substring(F.regexp_replace(html, r"^\s+", ""), 1, 256))
    is_feed = F.startswith(head, F.lit("<?xml")) | F.rlike(head, F.lit("<(rss|feed|urlset|sitemapindex)"))
    found = F.when(is_feed, feed_links(html)).otherwise(F.transform(links(html), lambda x: urls.joined(page, x)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.rlike(x, F.lit("(?i)^https?:")))))


def fit_markdown(markdown: Column) -> Column:
    """Lines without runs of blank ones, rules of one character, and repeats of the line before."""
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    kept = F.filter(lines, lambda x: ~F.rlike(F.trim(x), F.lit(r"^([-=_*])\1*$")))
    changed = F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))
    return F.regexp_replace(F.array_join(changed, "\n"), "^\n+|\n+$", "")


def tidy_markdown(markdown: Column) -> Column:
    """No blanks at line ends, no more than one blank line."""
    return F.regexp_replace(F.regexp_replace(markdown, r"[ \t]+(\n|$)", "$1"), "\n{3,}", "\n\n")


def as_markdown(text: Column) -> Column:
    """Trimmed lines that aren't empty, a blank line between them."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n\n")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t\n\r\f]+", " "))


def word_count(text: Column) -> Column:
    """Runs between white space."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda x: x != ""))


def token_count(text: Column) -> Column:
    """Runs of ASCII word characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def title(headings: Column, markdown: Column, longest: int = 160) -> Column:
    """The first heading, or else the first line that isn't empty."""
    first = F.get(F.filter(F.split(markdown, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.substring(F.trim(F.coalesce(F.get(headings, F.lit(0)), first, F.lit(""))), 1, longest)


def excerpt(text: Column, longest: int = 700) -> Column:
    return F.substring(one_line(text), 1, longest)


def looks_like_xml(text: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(text, 1, 256)))
    return F.rlike(head, F.lit(r"^(<\?xml|<rss|<feed|<urlset|<sitemapindex)"))


def script_markers(html: Column, words: Column) -> Column:
    """Marks of script-made pages in a page of so many words, in the order listed."""
    low = F.lower(F.coalesce(html, F.lit("")))
    scripts = F.size(F.split(low, "<script")) - 1

    def holds(*marks: str) -> Column:
        return F.greatest(F.lit(False), *[F.contains(low, F.lit(m)) for m in marks])

    return F.array_compact(
        F.array(
            F.when(holds("__next", "__next_data__"), "nextjs"),
            F.when(holds('id="root"', "id='root'", "data-reactroot"), "react-root"),
            F.when(holds("gatsby"), "gatsby"),
            F.when(scripts >= 20, F.concat(F.lit("scripts="), scripts.cast("string"))),
            F.when((words < 120) & (scripts >= 10), "low_text_high_script"),
        )
    )


def blocked_marker(text: Column, markers: Sequence[str]) -> Column:
    """The first marker that a text holds, in any case; null if none."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, F.lower(m))), F.lit(0))


def redacted(text: Column) -> Column:
    """Values of secret-like assignments, bearer tokens and credentials in URLs masked."""
    out = F.regexp_replace(text, r"(?i)\b(authorization|bearer|token|secret|password|passwd|api[_-]?key)(\s*[:=]\s*)(\"?)[^\s\"&]+", "$1$2$3[REDACTED]")
    return F.regexp_replace(out, r"(?i)(https?://)[^/\s@]+@", "$1[REDACTED]@")


def magic_type(content: Column) -> Column:
    """The file type that the first bytes of a binary column tell."""
    def starts(hex_digits: str) -> Column:
        return F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(hex_digits))

    return F.when(starts("25504446"), "pdf").when(starts("504B0304"), "zip").when(starts("D0CF11E0A1B11AE1"), "ole").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpeg").when(starts("47494638"), "gif")


def string_list(text: Column) -> Column:
    """A JSON list of strings, or else the parts between commas; trimmed, without empty ones."""
    parsed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    some = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.split(text, ","))
    return F.filter(F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def new_items(new: Column, old: Column) -> Column:
    """Items of a list that another lacks, in order, repeats kept."""
    return F.filter(new, lambda x: ~F.array_contains(old, x))
