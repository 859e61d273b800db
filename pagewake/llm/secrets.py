"""Secret scans with multipart credential linking (operator 7); DataFrame functions only.

Strong spans are reported wherever they stand: assignments to names such as `password`, access
identifiers and long hexadecimal runs. Weak spans are other identifiers, mixed runs of letters and
digits that may be secrets, and service endpoints; none means anything by itself. A weak span is
reported only if complementary parts co-occur: an identifier needs a secret, a secret needs an
identifier, an endpoint needs both, within `SCOPE` code points of the same document. Strong spans
are parts too; a weak span that overlaps a strong one is no candidate.

The parts are interval-joined by bins of `SCOPE` code points: what lies within reach of a span is in
its bin or a neighbouring one. Each bin is first reduced to the least and greatest start of its
identifiers and of its secrets, which decides the join exactly, so no pairs are made however many
parts a document holds.

Positions come from splitting a text at the matches: the lengths of gaps and matches add up to
code-point offsets. Spans are checkpointed without the texts, so that each text is scanned once.

Null texts count as empty: no spans, the digest of the empty string. Documents are told apart by
key and text: repeated rows get equal results, rows with a null key too, and an empty table gives an
empty one. Spans of one start are listed by kind. A text is read whole, in time linear in its length: labels of a
service's host have at most 63 characters and there are at most 8 before its domain. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

#: Code points within which parts belong together.
SCOPE = 400
#: Matches that are added up together.
BLOCK = 64

# The kinds in order, and the forms of secrets.
KINDS = ("assign", "access", "hex", "access_id", "secret", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGNED_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"A(?:KIA|SIA|ROA|IDA|GPA|NPA)[A-Z0-9]{8,}"
WEAK_SECRET = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"(?:https?://[A-Za-z0-9.-]+|(?:[a-z0-9-]{1,63}\.){1,8}amazonaws\.com)(?::[0-9]+)?"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a lambda over an array of one element names it."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """Running totals of an array of numbers: those of whole blocks first, so that long arrays aren't copied again and again."""
    zero = F.lit(0).cast("bigint")
    total = lambda x, start: F.aggregate(x, start, lambda out, v: out + v)

    def blocks(each: Column) -> Column:
        count = F.floor(F.size(each) / BLOCK).cast("int")
        return F.aggregate(F.sequence(F.lit(0), count), F.array(zero), lambda out, k: F.concat(out, F.array(total(F.slice(each, k * BLOCK + 1, F.lit(BLOCK)), F.get(out, k)))))

    def at(before: Column, each: Column) -> Column:
        return F.transform(each, lambda x, i: total(F.slice(each, i - i % BLOCK + 1, i % BLOCK + 1), F.get(before, F.floor(i / BLOCK).cast("int"))))

    return let(lengths, lambda each: let(blocks(each), lambda before: at(before, each)))


def spans(text: Column, pattern: str, kind: str, counts: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Sorted array of (start, kind, end) of the leftmost non-overlapping matches, in code points.

    `counts` says of the text of a group whether its match is kept.
    """

    def placed(hits: Column, gaps: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("bigint"))
        return let(running(lengths), lambda ends: F.transform(hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(ends, i).alias("end"))))

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = let(every(0), lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps)))
    if counts:
        found = let(every(group), lambda values: F.filter(found, lambda s, i: counts(F.get(values, i))))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array()).cast(SPAN)


def apart(parts: DataFrame) -> DataFrame:
    """The parts without the weak spans that overlap a strong one."""
    strong = F.col("kind") < KINDS.index("access_id")
    order = Window.partitionBy("scope").orderBy("start", "kind")
    ended = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(F.col("ended"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("begun"), F.col("end")) >= F.col("end"))
    return parts.withColumn("ended", ended).withColumn("begun", begun).where(strong | free).select("scope", "start", "kind", "end")


def written(found: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame) -> DataFrame:
    """scope and its reported weak spans; parts are (scope, start, kind, end)."""
    number = {k: i for i, k in enumerate(KINDS)}
    is_id = F.col("kind").isin(number["access"], number["access_id"])
    is_secret = F.col("kind").isin(number["assign"], number["hex"], number["secret"])
    binned = parts.withColumn("bin", F.floor(F.col("start") / SCOPE))
    each = [f(F.when(which, F.col("start"))).alias(name) for which, f, name in ((is_id, F.min, "id_lo"), (is_id, F.max, "id_hi"), (is_secret, F.min, "secret_lo"), (is_secret, F.max, "secret_hi"))]
    reduced = binned.where(is_id | is_secret).groupBy("scope", "bin").agg(*each)
    weak = binned.where(F.col("kind") >= number["access_id"]).withColumn("bin", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])))

    def near(part: str) -> Column:  # within a bin of the span's own, the least or the greatest start is the one in reach, if any is
        lo, hi = F.col(f"{part}_lo") - F.col("start"), F.col(f"{part}_hi") - F.col("start")
        return F.coalesce(F.bool_or((F.abs(lo) <= SCOPE) | (F.abs(hi) <= SCOPE)), F.lit(False)).alias(part)

    decided = weak.join(reduced, ["scope", "bin"]).groupBy("scope", "start", "kind", "end").agg(near("id"), near("secret"))
    needs = F.when(F.col("kind") == number["access_id"], F.col("secret")).when(F.col("kind") == number["secret"], F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return decided.where(needs).groupBy("scope").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak_spans"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans (all, as kind:start:end) of each row."""
    shared_folder(docs.sparkSession)
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    t = F.col("body")
    mixed = lambda v: F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Z]")) & F.rlike(v, F.lit("[a-z]"))
    found = body.select(
        key,
        F.sha2(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), t), 256).alias("scope"),
        spans(t, ASSIGN, "assign", lambda v: F.length(v) >= ASSIGNED_LENGTH, 2).alias("assign"),
        spans(t, ACCESS, "access").alias("access"),
        spans(t, HEX, "hex").alias("hex"),
        F.concat(spans(t, WEAK_ID, "access_id"), spans(t, WEAK_SECRET, "secret", mixed), spans(t, ENDPOINT, "endpoint")).alias("weak"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex")).checkpoint()

    parts = found.where(F.size("weak") > 0).dropDuplicates(["scope"]).select("scope", F.explode(F.concat("base", "weak")).alias("s")).select("scope", "s.*")
    out = found.join(linked(apart(parts)), "scope", "left").withColumn("all", F.concat("base", F.coalesce("weak_spans", F.array().cast(SPAN))))
    return out.select(
        key,
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
    )
