"""Access rules as data: robots, origins, pacing, budgets and lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.functions import urls


def parse_robots(files: DataFrame, key: str, body: str) -> DataFrame:
    """key, line, agent, allow, pattern of each rule; agents that follow each other share the rules below them.

    An agent without rules has one row, of nulls: it is named, and all is allowed to it. Agents other than
    `*` and product tokens are ignored.
    """
    lines = files.select(key, F.posexplode(F.split(body, "\r\n|\r|\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    told = lines.select(key, "line", F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy(key).orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = told.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(w))
    valid = F.rlike("value", F.lit(r"^(\*|[-A-Za-z_]+)$"))
    agents = grouped.where("field = 'user-agent'").where(valid).select(key, "group", F.lower("value").alias("agent")).distinct()
    rules = grouped.where("field <> 'user-agent' AND value <> ''").select(key, "group", "line", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    told = agents.join(rules, [key, "group"], "left").select(key, "line", "agent", "allow", "pattern")
    ruled = agents.join(rules, [key, "group"]).select(key, "agent").distinct()
    return told.where("pattern IS NOT NULL").unionByName(told.where("pattern IS NULL").join(ruled, [key, "agent"], "left_anti").distinct())


def selected_rules(rules: DataFrame, key: str, agent: str) -> DataFrame:
    """The rules of the agent's own groups, or else those for `*`."""
    own = rules.where(F.col("agent") == agent.lower())
    return own.unionByName(rules.where("agent = '*'").join(own.select(key).distinct(), key, "left_anti"))


#: Characters of a rule or target that stay as they are (fixed value).
SAFE = r"^[A-Za-z0-9/%?=&:+,;$!*'()@\[\]~._-]$"


def match_normal(text: Column) -> Column:
    return urls.escape_normal(text, SAFE)


def pattern_regex(pattern: Column) -> Column:
    """A regular expression of a rule: `*` for anything, `$` for the end."""
    quoted = F.regexp_replace(match_normal(F.regexp_replace(pattern, r"\$$", "")), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(F.endswith(pattern, F.lit("$")), F.lit("$")).otherwise(""))


def specificity(pattern: Column) -> Column:
    """Octets of a pattern without `*` and an end mark; an escape is one."""
    return F.octet_length(F.regexp_replace(F.regexp_replace(match_normal(F.regexp_replace(pattern, r"\$$", "")), r"\*", ""), "%[0-9A-F]{2}", "_"))


def allowed(targets: DataFrame, rules: DataFrame, key: str, target: str, row: str) -> DataFrame:
    """row, allowed, specificity: the longest matching rule decides, allow wins ties, no rule allows.

    `target` is a path, with its query if it has one.
    """
    rules = rules.withColumn("regex", pattern_regex(F.col("pattern")))
    targets = targets.withColumn("_target", match_normal(F.when(F.col(target) == "", "/").otherwise(F.col(target))))
    hit = F.rlike("_target", F.col("regex"))
    found = targets.join(rules, key, "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    found = found.withColumn("rank", F.when(F.col("hit"), F.struct(specificity(F.col("pattern")).alias("octets"), F.col("allow"))))
    return found.groupBy(row).agg(F.max("rank").alias("best")).select(row, F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.coalesce("best.octets", F.lit(0)).alias("specificity"))


def pacing_breaches(requests: DataFrame, origin: str, at: str, seconds: float) -> DataFrame:
    """Requests that came sooner after the origin's one before than the interval; `waited` in seconds."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    waited = (micros - F.lag(micros).over(Window.partitionBy(origin).orderBy(at, "id"))) / 1_000_000
    return requests.withColumn("waited", waited).where(F.col("waited") < seconds)


def budget_windows(requests: DataFrame, origin: str, at: str, seconds: float, limit: int) -> DataFrame:
    """id, window_start, slot, admitted: fixed windows anchored at an origin's first request after the last window.

    Each window depends on the one before, so an origin's requests are folded in order, in batches.
    """
    ordered = requests.select(origin, at, "id").repartition(origin).sortWithinPartitions(origin, at, "id")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, slot = None, 0.0, 0
        for part in parts:
            out = []
            for o, t, i in part.itertuples(index=False):
                if o != now or t >= start + seconds:
                    now, start, slot = o, t, 0
                slot += 1
                out.append((i, start, slot, slot <= limit))
            yield pd.DataFrame(out, columns=["id", "window_start", "slot", "admitted"])

    return ordered.mapInPandas(fold, "id bigint, window_start double, slot int, admitted boolean")


def redirect_breaks(hops: DataFrame, key: str) -> DataFrame:
    """Hops of a redirect chain that don't start where the one before ended, or go from https to http."""
    w = Window.partitionBy(key).orderBy("ordinal")
    before = F.lag("to_url").over(w)
    broken = before.isNotNull() & (before != F.col("from_url"))
    downgrade = F.startswith("from_url", F.lit("https:")) & F.startswith("to_url", F.lit("http:"))
    return hops.select("*", broken.alias("broken"), downgrade.alias("downgrade")).where("broken OR downgrade")


def access(status: Column, allowed_: Column) -> Column:
    """What the robots response of an origin lets a request do."""
    return F.when(status.isin(404, 410), "allow").when(status.isin(401, 403), "reject").when(status.between(200, 299), F.when(allowed_, "allow").otherwise("reject")).otherwise("error")


#: For each kind of robots observation but `valid_200`, outcome, reason and whether to retry.
DISPOSITIONS = {
    "http_404": ("allow", "robots.absent", False),
    "http_401": ("reject", "robots.auth_required", False),
    "http_403": ("reject", "robots.forbidden", False),
    "timeout": ("error", "robots.timeout", True),
    "dns_error": ("error", "robots.dns_error", True),
    "network_error": ("error", "robots.network_error", True),
    "parse_error": ("error", "robots.parse_error", False),
}


def disposition(kind: Column, allowed_: Column) -> Column:
    """Struct of outcome, reason and retryable of an access decision; null for an unknown kind."""
    def of(outcome: Column, reason: Column, retry: bool) -> Column:
        return F.struct(outcome.alias("outcome"), reason.alias("reason"), F.lit(retry).alias("retryable"))

    out = F.when(kind == "valid_200", of(F.when(allowed_, "allow").otherwise("reject"), F.when(allowed_, "robots.allowed").otherwise("robots.disallowed"), False))
    for name, (outcome, reason, retry) in DISPOSITIONS.items():
        out = out.when(kind == name, of(F.lit(outcome), F.lit(reason), retry))
    return out


def has_userinfo(text: Column) -> Column:
    """Whether a text holds a URI with user information, as it is or percent-decoded once or twice.

    Full-width and small forms of the marks count as the marks.
    """
    def decoded(x: Column) -> Column:  # escapes of ASCII, and of the other forms of the marks
        for octets, char in (("%EF%BC%A0|%EF%B9%AB", "@"), ("%EF%BC%9A|%EF%B9%95", ":"), ("%EF%BC%8F", "/")):
            x = F.regexp_replace(x, f"(?i){octets}", char)
        tokens = F.regexp_extract_all(x, F.lit(r"(?s)%[0-7][0-9A-Fa-f]|."), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) == 3, F.char(F.conv(F.substring(t, 2, 2), 16, 10).cast("bigint"))).otherwise(t)), "")

    def marked(x: Column) -> Column:
        return F.rlike(F.translate(x, "\uff20\ufe6b\uff1a\ufe55\uff0f", "@@::/"), F.lit(r"//[^/?#\s@]*@"))

    once = decoded(text)
    return marked(text) | (F.contains(text, F.lit("%")) & (marked(once) | marked(decoded(once))))
