"""URL filters by expressions of host suffix and path prefix.

Each URL is expanded into the expressions that some rule could have: a suffix of its host with as many
labels as a rule's host, followed by a prefix of its path as long as a rule's path. Expressions and rules
are joined on the first four bytes of their SHA-256 digests; a match counts only where the whole digests
agree. The longest rule wins; of equally long ones a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
#: Rules are broadcast up to this many rows (about 200 bytes each); beyond that the join shuffles.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; '' where there is no '://'."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the expressions of a URL with the shapes (labels of the host, characters of the path)."""
    labels = F.split(host, "\\.")
    found = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= k),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, k)),
        )
        for n, k in shapes
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to `urls`; `rules` has host, path and verdict.

    A null or malformed URL (no '://') has an empty host and path, meets no rule and takes `default`.
    Repeated rows are each judged; an input column with the name of a result column is replaced; an
    empty table gives an empty result. Rules with a null or empty host never match. The verdict of a
    URL depends on its host and path alone, so each distinct pair is looked up once.
    """
    rules = (
        rules.where("host is not null and host <> ''")
        .select(
            F.translate("host", UPPER, LOWER).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            F.col("verdict").alias("rule_verdict"),
        )
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    shape = rules.select(F.size(F.split("rule_host", "\\.")).alias("n"), F.length("rule_path").alias("k"))
    shapes = [(r["n"], r["k"]) for r in shape.distinct().collect()]  # at most labels x lengths of a name
    known = rules.select("prefix", "digest", "rule", "rule_verdict")
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)

    own = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    link = F.col(f"`{url}`")
    aside = {c: f"own_{i}" for i, c in enumerate(own)}  # names that those below cannot clash with
    parts = urls.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()], url_host(link).alias("host"), url_path(link).alias("path"))
    parts = parts.fillna("", ["host", "path"])
    pairs = parts.select("host", "path").distinct()
    asked = (
        pairs.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    hits = asked.join(known, "prefix").where("full = digest")
    rank = F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), F.col("rule").alias("r"))
    best = hits.groupBy("host", "path").agg(
        F.max_by("rule", rank).alias("rule"), F.max_by("rule_verdict", rank).alias("found")
    )
    return (
        parts.join(best, ["host", "path"], "left")
        .withColumn("verdict", F.coalesce("found", F.lit(default)))
        .select(*[F.col(a).alias(c) for c, a in aside.items()], "host", "path", "rule", "verdict")
    )
