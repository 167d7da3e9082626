"""Vocabulary trees: concepts(uri, label, broader, ord) by a recursive query."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.session import settle


def preferred(labels: Column, languages: tuple[str, ...], default: Column) -> Column:
    """The label in the first available language of a map, else any, else the default."""
    wanted = [F.try_element_at(labels, F.lit(code)) for code in languages]
    return F.coalesce(*wanted, F.get(F.map_values(labels), F.lit(0)), default)


#: Concepts that a recursive query may walk: Spark's own limit of rows.
RECURSIVE_ROWS = 1_000_000


def in_language(concepts: DataFrame, labels: str = "labels", languages: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """The concepts with `label` from a map of language to text: the first language that a concept has, else its uri."""
    return concepts.withColumn("label", preferred(F.col(labels), languages, F.col("uri"))).drop(labels)


def _levels(concepts: DataFrame) -> DataFrame:
    """tree()'s walk as one join for each level, for more concepts than a recursive query may walk."""
    step = concepts.select("uri", "label", "broader", F.lpad(F.col("ord").cast("string"), 12, "0").alias("key"))
    walk = settle(step.where("broader is null").select("uri", F.lit(0).alias("depth"), F.array("uri").alias("path"), F.array("key").alias("keys"), F.array("label").alias("labels")))
    levels = [walk]
    while not walk.isEmpty():
        parent = walk.select(F.col("uri").alias("broader"), "depth", "path", "keys", F.col("labels").alias("names"))
        below = step.join(parent, "broader").where(~F.array_contains("path", F.col("uri")))
        grown = [F.array_append("path", F.col("uri")).alias("path"), F.array_append("keys", F.col("key")).alias("keys"), F.array_append("names", F.col("label")).alias("labels")]
        walk = settle(below.select("uri", (F.col("depth") + 1).alias("depth"), *grown))
        levels.append(walk)
    return reduce(DataFrame.unionByName, levels)


def tree(concepts: DataFrame, title: str = "") -> DataFrame:
    """(uri, depth, path, anchor, position): every concept below a top one, position in depth-first order.

    A concept that is its own ancestor ends the walk there. A recursive query walks up to RECURSIVE_ROWS concepts of a
    depth up to 100; a larger vocabulary is walked level by level.
    """
    if concepts.count() >= RECURSIVE_ROWS:
        return _shown(_levels(concepts), title)
    view = f"concepts_{uuid.uuid4().hex}"
    concepts.createOrReplaceTempView(view)
    found = concepts.sparkSession.sql(f"""
        WITH RECURSIVE walk(uri, depth, path, keys, labels) AS (
            SELECT uri, 0, array(uri), array(lpad(cast(ord AS string), 12, '0')), array(label) FROM {view} WHERE broader IS NULL
            UNION ALL
            SELECT c.uri, w.depth + 1, array_append(w.path, c.uri), array_append(w.keys, lpad(cast(c.ord AS string), 12, '0')),
                array_append(w.labels, c.label)
            FROM {view} c JOIN walk w ON c.broader = w.uri
            WHERE NOT array_contains(w.path, c.uri))
        SELECT * FROM walk""")
    return _shown(found, title)


def _shown(found: DataFrame, title: str) -> DataFrame:
    names = F.filter(F.concat(F.array(F.lit(title)), F.col("labels")), lambda x: x != "")
    return found.select("uri", "depth", "path", F.array_join(names, " → ").alias("anchor"), F.array_join("keys", "/").alias("position"))


def select_concepts(walked: DataFrame, mode: str = "all", root: str | None = None, uris: list[str] | None = None) -> DataFrame:
    """All concepts, those below a root, or those of a list; unknown ones are refused."""
    if mode == "all":
        return walked
    if mode == "subtree":
        if walked.where(F.col("uri") == root).isEmpty():
            raise ValueError(f"Unknown concept {root!r}.")
        return walked.where(F.array_contains("path", root))
    if mode == "list":
        wanted = sorted(set(uris or []))
        known = walked.where(F.col("uri").isin(wanted)).select("uri").distinct().count()
        if known < len(wanted):
            raise ValueError(f"The selection names {len(wanted) - known} unknown concepts.")
        return walked.where(F.col("uri").isin(wanted))
    raise ValueError(f"Unknown selection {mode!r}.")


def plan(selected: DataFrame, seeds: DataFrame, per_concept: int) -> DataFrame:
    """(uri, anchor, seed_count, needed) of every selected concept; `seeds` has uri."""
    counts = seeds.groupBy("uri").agg(F.count("*").alias("seed_count"))
    return selected.join(counts, "uri", "left").select("uri", "anchor", F.coalesce("seed_count", F.lit(0)).cast("long").alias("seed_count"), F.lit(per_concept).cast("long").alias("needed"))


def estimate(planned: DataFrame, batch: int, tokens: int = 2000) -> DataFrame:
    """total_target, estimated_calls and estimated_tokens of a plan."""
    calls = F.coalesce(F.sum(F.ceil(F.col("needed") / F.lit(batch))), F.lit(0)).cast("long")
    total = F.coalesce(F.sum("needed"), F.lit(0)).cast("long")
    return planned.agg(total.alias("total_target"), calls.alias("estimated_calls"), (calls * tokens).alias("estimated_tokens"))


def slugs(lines: DataFrame, base: str, column: str = "line", order: str = "ord") -> DataFrame:
    """(ord, uri, label) of pasted lines 'label' or 'uri label'; a repeated slug gets -2, -3 and so on."""
    from pyspark.sql import Window

    text = F.trim(F.col(column))
    first = F.split_part(text, F.lit(" "), F.lit(1))
    given = first.rlike("^https?://")
    label = F.when(given, F.trim(F.expr(f"substring(trim({column}), length(split_part(trim({column}), ' ', 1)) + 1)"))).otherwise(text)
    plain = F.translate(F.lower(label), "äöüß", "aous")
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = lines.where(text != "").select(order, label.alias("label"), F.when(given, first).alias("given"), slug.alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    suffix = F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")
    uri = F.coalesce("given", F.concat(F.lit(base.rstrip("/") + "/"), F.col("slug"), suffix))
    return rows.select(order, uri.alias("uri"), F.when(F.col("label") == "", uri).otherwise(F.col("label")).alias("label"))
