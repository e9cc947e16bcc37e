"""Rules of robots.txt for every crawler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def disallowed(robots: Column) -> Column:
    """The path prefixes that the groups of user agent * disallow, in order; none for an empty text.

    Lines lose what follows a #; keys are in any case; rules before the first user agent don't count,
    and an empty Disallow forbids nothing."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    start = F.struct(F.lit(False).alias("any"), F.array().cast("array<string>").alias("rules"))

    def step(state: Column, pair: Column) -> Column:
        mine = F.when(pair["key"] == "user-agent", pair["value"] == "*").otherwise(state["any"])
        rule = state["any"] & (pair["key"] == "disallow") & (F.length(pair["value"]) > 0)
        return F.struct(mine.alias("any"), F.when(rule, F.array_append(state["rules"], pair["value"])).otherwise(state["rules"]).alias("rules"))

    return F.aggregate(pairs, start, step, lambda state: state["rules"])


def allowed(rules: Column, path: Column) -> Column:
    """Whether no rule is a prefix of the path; an empty path is /."""
    at = F.when(F.length(path) > 0, path).otherwise("/")
    return ~F.exists(rules, lambda r: F.startswith(at, r))
