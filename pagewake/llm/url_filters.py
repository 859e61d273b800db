"""URL filters (operator 6).

A blocked Bloom filter of the listed canonical URLs lets possible hits through to an exact hash
join, which removes the false positives. A block is four 64-bit words; a URL has one block and
one bit in each of its words, so a probe reads one row of the block table.

The filter is a table of blocks, not a driver object: Spark broadcasts it while it is below
`spark.sql.autoBroadcastJoinThreshold` and else joins it by block number, so neither side has
a size limit. Repeated URLs on the list collapse before the filter is built; AQE splits the
partitions of repeated URLs on the probing side.

Path rules come first: a rule fits its host and all subdomains when the path starts with the
rule's path, and the longest (host and path) wins. Their number is a parameter, not data.

Null, empty and relative URLs have an empty host and path: no rule, no listed URL, allowed.
Repeated rows are judged alike; extra columns are not carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL: about one false positive in a hundred.
BITS_PER_URL = 12
WORDS = 4


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty strings without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading `www.` or `m.`, and path without slashes at its end; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", "")))


def bits(key: Column) -> list[Column]:
    """The bit of each word."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int")) for i in range(WORDS)]


def block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The block table of a one-column list: block, w0 .. w3."""
    key = F.col(listed.columns[0])
    put = listed.select(block(key, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits(key))])
    return put.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and listed (whether the exact list holds the canonical URL).

    `listed` has one column of canonical URLs (see `canonical`), nulls ignored; `rules` are
    (host, path, verdict). Without a rule a listed URL is blocked and any other allowed.
    """
    name = listed.columns[0]
    urls = listed.where(F.col(name).isNotNull()).distinct()
    blocks = max(1, -(-urls.count() * BITS_PER_URL // (64 * WORDS)))
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canon"))

    found = rows.withColumn("block", block(F.col("canon"), blocks)).join(bloom(urls, blocks), "block", "left")
    passes = reduce(and_, [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits(F.col("canon")))])
    # A row that the filter rejects gets a key that no listed URL can equal (one starts with a host), spread by its hash.
    probe = found.withColumn("probe", F.when(F.coalesce(passes, F.lit(False)), F.col("canon")).otherwise(F.concat(F.lit("/"), F.xxhash64(F.col(key), "path").cast("string"))))
    out = probe.join(urls.select(F.col(name).alias("probe"), F.lit(True).alias("hit")), "probe", "left")
    listed_now = F.coalesce(F.col("hit"), F.lit(False))
    return out.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(listed_now, "block").otherwise("allow")).alias("verdict"), listed_now.alias("listed"))
