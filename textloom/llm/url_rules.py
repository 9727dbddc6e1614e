"""Block and allow rules for URLs, found by hashed expressions.

A rule names a host and the start of a path and holds for the host and all of
its subdomains. Each URL is expanded into the expressions that could be a rule:
a suffix of its host times a prefix of its path, but only in the *shapes*
(number of host labels, length of path) that some rule has. Expressions meet
rules in an equi-join on the first 32 bits of their SHA-256; the full digest
confirms, and the longest rule decides. Native expressions only.

Defined results: a NULL URL or one without ``://`` has an empty host and path
and gets the default verdict; a repeated row is judged again; no rules or no
pages give the default verdict or no rows; of two fitting rules of one length
the one with the longer host wins, then ``block``; rules with a NULL are left
out. Other columns of the pages are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST_PREFIX = 8  # hexadecimal digits: 32 bits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL, both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """'#' cannot occur in a host, so the pair is read from the text in one way only."""
    return F.sha2(F.concat(host, F.lit("#"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id",
               default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every row of ``pages``. ``rules``
    has ``host``, ``path`` and ``verdict``; ``rule`` is their host and path as text.

    The rules' side is broadcast only if Spark finds it below
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise the join is shuffled and
    adaptive execution splits a hot expression. Equal URLs are judged once."""
    parsed = pages.select(F.col(key).alias("_key"), *[
        c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col(url)))])
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("_host"),
        F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    hashed = known.select("*", _digest(F.col("_host"), F.col("_path")).alias("_full")).select(
        "*", F.substring("_full", 1, DIGEST_PREFIX).alias("_short"))
    # One row for each shape that a rule has, however many rules there are.
    shapes = [(r.labels, r.chars) for r in known.select(
        _labels(F.col("_host")).alias("labels"), F.length("_path").alias("chars")).distinct().collect()]
    if not shapes:
        return parsed.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))

    host, path = F.col("host"), F.col("path")
    shape = F.explode(F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in sorted(shapes)]))
    expanded = (
        parsed.select("host", "path").distinct()
        .select("*", shape.alias("s"))
        .where((_labels(host) >= F.col("s.labels")) & (F.length(path) >= F.col("s.chars")))
        .select("host", "path",
                _digest(F.call_function("substring_index", host, F.lit("."), -F.col("s.labels")),
                        F.substr(path, F.lit(1), F.col("s.chars"))).alias("full"))
        .select("*", F.substring("full", 1, DIGEST_PREFIX).alias("short"))
    )
    rule = F.concat("_host", "_path")
    order = F.struct(F.length(rule), F.length("_host"), (F.col("_verdict") == "block").cast("int"))
    best = (
        expanded.join(hashed, (F.col("short") == F.col("_short")) & (F.col("full") == F.col("_full")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(rule.alias("rule"), F.col("_verdict").alias("verdict")), order).alias("best"))
    )
    return parsed.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
