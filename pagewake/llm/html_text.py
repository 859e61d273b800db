"""Main-text extraction from HTML by line-block distribution (operator 2).

Markup is stripped into lines: each block element with text starts a line, inline elements don't, an
empty one is an empty line, and elements that never hold main text (menus, forms, sidebars, comments,
scripts ...) leave a gap of empty lines. An element that only has a part of a compound name to tell it
(`with-sidebar`) is left out unless it holds more than `SHARE` of the page's text outside links. The
lengths of the lines are summed over sliding windows; text begins where the sum surges over a
threshold and ends where it dives to nothing, and the lines between are kept.

Text of links counts nothing, and if no window reaches the threshold the fullest run of lines is kept.
Lines of a marked region (`article`, `main`) count whole and weigh `SURGE` more; lines outside are
then left out, unless one run of them holds more text than any region: such marks are of a teaser,
and the sums decide without them. Character references are decoded, white space inside a line becomes
one blank, and lines are joined in page order by one blank. Whole pages are read.

A null or empty page gives an empty text. Pages are independent: one row out for each row in,
repeated rows included; other columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters outside links that mark a surge.
WINDOW = 3
SURGE = 86
#: Share of a page's text outside links over which a part of a name doesn't drop an element.
SHARE = 0.5

# Element names of HTML, and the words by which pages name their parts.
RAW = "script style noscript template title textarea iframe object svg math canvas audio video select xmp noembed noframes"
BOILERPLATE = set("nav header footer aside form menu dialog button fieldset".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies copyright disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe tags toolbar widget widgets complementary contentinfo alert alertdialog".split()
)

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNNAMED = set("html body main".split())


def is_boilerplate(tag: str, attributes: str) -> bool | None:
    """Whether an element holds no main text, by its name, its class, id or role, or because it is hidden; None if only a part of a name says so."""
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in UNNAMED:
        return False
    found: bool | None = False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name in ("class", "id", "role"):
            if NAMES.intersection(value.split()):
                return True
            if NAMES.intersection(re.split(r"[^a-z]+", value)):
                found = None
    return found


@dataclass
class Lines:
    """Text of a page by line; parallel lists of texts, characters outside links, numbers of marked regions (0 outside), doubtful elements around, and the doubtful element whose gap a line is."""

    text: list[str] = field(default_factory=lambda: [""])
    weight: list[int] = field(default_factory=lambda: [0])
    region: list[int] = field(default_factory=lambda: [0])
    around: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    gap_of: list[int] = field(default_factory=lambda: [0])

    def start(self, region: int, around: tuple[int, ...], gap: int = 1, gap_of: int = 0) -> None:
        for _ in range(gap):
            self.text.append("")
            self.weight.append(0)
            self.region.append(region)
            self.around.append(around)
            self.gap_of.append(gap_of)

    def settled(self) -> Lines:
        """Without the doubtful elements that hold a small share of the text; the others leave no gap."""
        held = Counter()
        weights = [w if t.strip() else 0 for t, w in zip(self.text, self.weight, strict=True)]
        for w, around in zip(weights, self.around, strict=True):
            held.update(dict.fromkeys(around, w))
        total = sum(weights)
        stay = {d for d, w in held.items() if w > SHARE * total}
        left = Lines([], [], [], [], [])
        for t, w, r, around, gap_of in zip(self.text, self.weight, self.region, self.around, self.gap_of, strict=True):
            if gap_of not in stay:
                fine = stay.issuperset(around)
                left.start(r, around)
                left.text[-1], left.weight[-1] = (t, w) if fine else ("", 0)
        return left


def strip(page: str) -> Lines:
    """Strips the markup of a page."""
    lines, open_tags, dropped, links, regions, at = Lines(), [], 0, 0, 0, 0
    n_regions, n_doubtful, around, opened = 0, 0, (), None
    closing = {}  # last place of an element's end tag, to tell elements that are never closed

    def closed_later(tag: str, place: int) -> bool:
        if tag not in closing:
            closing[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}[\s>]", page, re.I)), default=-1)
        return closing[tag] >= place

    def add(text: str) -> None:
        if text and not dropped:
            lines.text[-1] += text
            if not links:
                lines.weight[-1] += len(text)

    def start(gap: int = 1, gap_of: int = 0) -> None:
        lines.start(n_regions if regions else 0, around, gap, gap_of)

    def end(empty: bool) -> None:
        """Ends a line with text, or an empty one; other white space between tags is no line."""
        if empty or lines.text[-1].strip():
            start()
        else:
            lines.text[-1], lines.weight[-1] = "", 0

    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not (tag := (m[3] or "").lower()):
            continue
        block = tag not in INLINE
        if m[2]:
            if any(tag == t for t, *_ in open_tags):
                while True:
                    t, drops, region, doubtful = open_tags.pop()
                    dropped, regions = dropped - drops, regions - region
                    links -= t == "a"
                    if doubtful:
                        around = around[:-1]
                    if drops and not dropped:
                        start(WINDOW + 1)
                    elif doubtful and not dropped:
                        start(1)
                        start(WINDOW, doubtful)
                        start(1)
                    if region and not regions:
                        start(WINDOW + 1)
                    if t == tag:
                        break
            if block:
                end(opened == tag)
            opened = None
            continue
        drops = is_boilerplate(tag, m[4])
        if drops is not False and (tag in VOID or not closed_later(tag, at)):
            drops = False
        doubtful = drops is None and not dropped
        drops = bool(drops)
        region = tag in ("article", "main") and not drops and not dropped
        lasting = tag not in VOID and not m[4].endswith("/") and (drops or region or doubtful or not dropped or closed_later(tag, at))
        doubtful = n_doubtful + 1 if doubtful and lasting else 0
        first = region and not regions
        if lasting:
            open_tags.append((tag, int(drops), int(region), doubtful))
            links, regions, n_regions = links + (tag == "a"), regions + region, n_regions + first
        if doubtful:
            n_doubtful, around = doubtful, (*around, doubtful)
            start(1)
            start(WINDOW, doubtful)
            start(1)
        if drops and not dropped or first:
            start(WINDOW + 1)
        if block:
            end(tag in VOID)
        if lasting:
            dropped += drops
        opened = tag
    add(page[at:])
    return lines.settled()


def surges(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Runs of lines between surge and dive points; without any surge, the run with most text."""
    n = len(weights)
    before = [0]
    for w in weights:
        before.append(before[-1] + w)
    sums = [before[min(n, i + WINDOW)] - before[i] for i in range(n)]
    runs, start = [], None  # runs of windows that hold text
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            runs.append((start, i))
            start = None
    chosen = [r for r in runs if max(sums[r[0] : r[1]]) >= surge]
    if not chosen and runs:
        chosen = [max(runs, key=lambda r: sum(weights[r[0] : r[1]]))]
    return chosen


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    lines = strip(page)
    texts = [" ".join(html.unescape(t).split()) if t else "" for t in lines.text]
    plain = [w if t else 0 for t, w in zip(texts, lines.weight, strict=True)]
    chosen = surges(plain, SURGE)
    held = Counter()  # text of each region
    for t, r in zip(texts, lines.region, strict=True):
        if t and r:
            held[r] += len(t)
    if held:
        weighed = [len(t) + SURGE if t and r else w for t, w, r in zip(texts, plain, lines.region, strict=True)]
        runs = surges(weighed, SURGE)
        inside = [r for r in runs if any(t and m for t, m in zip(texts[r[0] : r[1]], lines.region[r[0] : r[1]], strict=True))]
        outside = [sum(plain[a:b]) for a, b in runs if (a, b) not in inside]
        if max(outside, default=0) <= max(held.values()):
            chosen = inside
    return " ".join(t for a, b in chosen for t in texts[a:b] if t)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row for each page: key, url, text, n_chars (code points)."""
    kinds = {k: pages.schema[k].dataType.simpleString() for k in (key, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
