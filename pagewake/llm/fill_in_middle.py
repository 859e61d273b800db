"""Fill-in-the-middle transformation (operator 13).

A text is a run of units, the matches of a pattern from left to right; what a pattern leaves
unmatched belongs to the unit after it, or to the suffix. Two cuts at unit boundaries make prefix, middle
and suffix, which are put in the order prefix-suffix-middle (psm) or suffix-prefix-middle (spm)
between three marks, so that a model learns to fill the middle in.

The cuts come from two passes of a lazy matcher: the first counts the units, the second advances an
iterator to the smaller and the larger rank. Both hold one match at a time, so the memory is that of the
text, however many units it has. The numbers drawn come from the SHA-256 of seed and key: the same
row gives the same cut on every machine and after every retry. One pass over the table, no shuffle.

A null text counts as empty. Empty texts, texts that hold a mark, texts whose draw isn't below `percent`,
and texts that the marks wouldn't let restore are left as they are (plain; prefix_chars and middle_chars
null). A null key is drawn as the empty string. Equal keys draw equal numbers; repeated rows stay and give equal
rows; an empty table gives an empty one; further columns are not read and can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Recipe:
    """Pattern of a unit, seed, percentages of transformed texts and of spm among them, and the marks."""

    units: str = LINES
    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(recipe: Recipe, key: object) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of seed and key."""
    digest = hashlib.sha256(f"{recipe.seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def boundary(matches: Iterator[regex.Match], units: int, start: int) -> int:
    """Where the last of the next `units` matches ends; `start` if there are none to take. No match is kept."""
    for match in islice(matches, units):
        start = match.end()
    return start


def cut(pattern: regex.Pattern, text: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of units n, and the places after `first % (n + 1)` and `second % (n + 1)` units, the smaller first."""
    n = sum(1 for _ in pattern.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = pattern.finditer(text)
    a = boundary(matches, low, 0)
    return n, a, boundary(matches, high - low, a)


def arrange(recipe: Recipe, form: str, before: str, between: str, after: str) -> str:
    p, s, m = recipe.marks
    return f"{p}{before}{s}{after}{m}{between}" if form == PSM else f"{s}{after}{p}{before}{m}{between}"


def restore(recipe: Recipe, form: str, output: str) -> str:
    """The text that `output` was made of."""
    p, s, m = recipe.marks
    if form == PLAIN:
        return output
    opening, inner = (p, s) if form == PSM else (s, p)
    left, _, rest = output[len(opening) :].partition(inner)
    right, _, between = rest.partition(m)
    return left + between + right if form == PSM else right + between + left


def transform_text(recipe: Recipe, pattern: regex.Pattern, key: object, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    h1, h2, h3, h4 = draws(recipe, key)
    n, a, b = cut(pattern, text, h1, h2)
    if text and h3 % 100 < recipe.percent and not any(mark in text for mark in recipe.marks):
        form = SPM if h4 % 100 < recipe.spm_percent else PSM
        output = arrange(recipe, form, text[:a], text[a:b], text[b:])
        if restore(recipe, form, output) == text:
            return n, form, a, b - a, output
    return n, PLAIN, None, None, text


def transform(docs: DataFrame, recipe: Recipe | None = None, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """A row for each document: key, n, form, prefix_chars, middle_chars, and the output.

    With `digests`, output_sha256 and restored_sha256 (of the text rebuilt from output and form) stand for the output.
    """
    recipe = recipe or Recipe()
    kind = docs.schema[key].dataType.simpleString()
    tail = "output_sha256 string, restored_sha256 string" if digests else "output string"
    schema = f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {tail}"
    names = [key, "n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digests else ["output"])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] * (2 if digests else 1))]

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(recipe.units)
        for batch in pieces(batches, 1):
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                *told, output = transform_text(recipe, pattern, k, t.as_py() or "")
                out.append((*told, sha(output), sha(restore(recipe, told[1], output))) if digests else (*told, output))
            columns = [pa.array([row[i] for row in out], kind_) for i, kind_ in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
