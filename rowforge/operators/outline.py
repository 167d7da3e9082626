"""Depth, size and depth-first place of every concept of a forest of any depth, in rounds that multiply their reach.

A depth-first walk enters and leaves each concept once. What comes next is known at once: behind an entry the entry of
the first child, or the exit where there is none; behind an exit the entry of the next sibling, or the parent's exit.
These 2 n steps are one list, which pointer jumping ranks: each round adds to a step what the step it points to has
gathered, and points where that one pointed, twice over. After k rounds 3**k steps are gathered, so a path of 100,000
concepts takes 12 rounds.

Concepts that have none below them, most of a usual vocabulary, stay out of that list: how many of them stand behind an
entry or an exit is counted once and moves along with that step, and their own places follow from it at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.session import settle


def _dealt(concepts: DataFrame) -> DataFrame:
    """(id, uri, parent, range, up, leaf): each concept once, with a number in the order of (parent, ord, uri) and its parent's.

    Concepts are dealt into ranges of that order, so that a parent of very many has many tasks; parent is '' on top. A
    leaf has a parent and nothing below it.
    """
    parent = F.when(F.col("broader").isNull(), F.lit("")).otherwise(F.concat(F.lit(">"), "broader"))
    once = concepts.groupBy("uri").agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), parent.alias("parent"))).alias("c")).select("uri", "c.*")
    dealt = once.repartitionByRange("parent", "ord", "uri").sortWithinPartitions("parent", "ord", "uri")
    dealt = settle(dealt.select(F.monotonically_increasing_id().alias("id"), "uri", "parent", F.spark_partition_id().alias("range")))
    inner = dealt.where("parent <> ''").select(F.expr("substring(parent, 2)").alias("uri")).distinct().withColumn("inner", F.lit(True))
    ups = dealt.select(F.concat(F.lit(">"), "uri").alias("parent"), F.col("id").alias("up"))
    leaf = F.col("inner").isNull() & (F.col("parent") != "")
    return settle(dealt.join(inner, "uri", "left").join(ups, "parent", "left").select("id", "uri", "parent", "range", "up", leaf.alias("leaf")))


def _following(rows: DataFrame) -> DataFrame:
    """Add after, the number of the next sibling; the first of the next range follows the last of a range."""
    heads = rows.groupBy("range").agg(F.min(F.struct("id", "parent")).alias("head"))
    heads = heads.select((F.lead("range", -1).over(Window.orderBy("range"))).alias("range"), "head")  # a row for each range
    by = Window.partitionBy("range").orderBy("id")
    following = F.coalesce(F.lead(F.struct("id", "parent")).over(by), F.col("head"))
    rows = rows.join(heads.where("range is not null"), "range", "left").withColumn("f", following)
    return rows.withColumn("after", F.when(F.col("f.parent") == F.col("parent"), F.col("f.id"))).drop("f", "head")


def _leaves(rows: DataFrame) -> DataFrame:
    """(id, uri, up, behind, place): each leaf with the sibling behind whose end it stands, null behind its parent's entry,
    and its number, from 0, among the leaves that stand there."""
    before = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(~F.col("leaf"), F.struct("id", "parent"))
    each = rows.groupBy("range").agg(F.count_if("leaf").alias("leaves"), F.max(whole).alias("last"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = each.select("range", F.coalesce(F.sum("leaves").over(earlier), F.lit(0)).alias("base"), F.last("last", True).over(earlier).alias("far"))
    # `last` is the nearest concept before that is no leaf; behind another parent's it is none of the siblings.
    nearest = F.coalesce(F.last(whole, True).over(before), F.col("far"))
    n = F.col("base") + F.coalesce(F.sum(F.col("leaf").cast("long")).over(before), F.lit(0))
    placed = rows.join(carried, "range").withColumns({"n": n, "nearest": nearest}).where("leaf and up is not null")
    behind = F.when(F.col("nearest.parent") == F.col("parent"), F.col("nearest.id"))
    placed = placed.select("id", "uri", "up", behind.alias("behind"), "n")
    first = placed.groupBy("up", "behind").agg(F.min("n").alias("first")).withColumnsRenamed({"up": "up_", "behind": "behind_"})
    same = (F.col("up") == F.col("up_")) & F.col("behind").eqNullSafe(F.col("behind_"))
    return settle(placed.join(first, same).select("id", "uri", "up", "behind", (F.col("n") - F.col("first")).alias("place")))


def outline(concepts: DataFrame) -> DataFrame:
    """(uri, depth, size, place) of every concept below a top one, from (uri, broader, ord).

    size counts a concept and all below it; place is its number in a depth-first walk over all tops, from 0, so that
    what lies below a concept has the places from its own up to place + size. Siblings are in the order of ord, then
    uri. A concept under several broader ones stands below the first by (ord, broader) only. Concepts below none that is
    on top, in circles or under unknown ones, have no row.
    """
    rows = _dealt(concepts)
    leaves = _leaves(rows)
    rows = settle(_following(rows.where("not leaf")))
    n = rows.count()
    first = rows.where("parent <> ''").groupBy(F.col("up").alias("id")).agg(F.min("id").alias("child"))
    inside = leaves.where("behind is null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("inside"))
    beside = leaves.where("behind is not null").groupBy(F.col("behind").alias("id")).agg(F.count("*").alias("beside"))
    known = rows.join(first, "id", "left").join(inside, "id", "left").join(beside, "id", "left").fillna(0, ["inside", "beside"])
    lost = F.lit(-1).cast("long")  # below an unknown concept: never reaches the end
    leave = F.when(F.col("after").isNotNull(), F.col("after") * 2).when(F.col("parent") != "", F.coalesce(F.col("up") * 2 + 1, lost))
    enter = F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1)
    both = F.array(
        F.struct((F.col("id") * 2).alias("step"), enter.alias("next"), (1 + F.col("inside")).alias("entries"), F.lit(1).cast("long").alias("down")),
        F.struct((F.col("id") * 2 + 1).alias("step"), leave.alias("next"), F.col("beside").alias("entries"), F.lit(-1).cast("long").alias("down")),
    )
    steps = settle(known.select(F.explode(both).alias("s")).select("s.*"))
    for _ in range(next(r for r in range(1, 64) if 3**r >= 2 * n)):
        ahead = steps.select(F.col("step").alias("next"), F.col("next").alias("beyond"), F.col("entries").alias("more"), F.col("down").alias("deeper"))
        moved = steps.where("next is not null").join(ahead, "next")
        moved = moved.select("step", F.col("beyond").alias("next"), F.col("entries") + F.col("more"), F.col("down") + F.col("deeper")).toDF(*steps.columns)
        further = moved.where("next is not null").join(ahead, "next")
        further = further.select("step", F.col("beyond").alias("next"), F.col("entries") + F.col("more"), F.col("down") + F.col("deeper"))
        moved = moved.where("next is null").union(further)
        steps = settle(steps.where("next is null").union(moved))
        if steps.where("next is not null").isEmpty():
            break
    ended = steps.where("next is null")
    entered = ended.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("id"), F.col("entries").alias("left"), (-F.col("down")).alias("depth"))
    left = ended.where("step % 2 = 1").select(((F.col("step") - 1) / 2).cast("long").alias("id"), F.col("entries").alias("behind"))
    whole = entered.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    found = rows.select("id", "uri").join(entered, "id").join(left, "id")
    found = settle(found.select("id", "uri", F.col("depth").cast("int").alias("depth"), (F.col("left") - F.col("behind")).alias("size"), (F.lit(whole) - F.col("left")).alias("place")))
    at = found.select(F.col("id").alias("at"), "depth", "size", F.col("place").alias("start"))
    hung = leaves.withColumn("at", F.coalesce("behind", "up")).join(at, "at")
    inner = F.col("behind").isNull()
    depth, start = F.when(inner, F.col("depth") + 1).otherwise(F.col("depth")), F.when(inner, 1).otherwise(F.col("size"))
    hung = hung.select("uri", depth.alias("depth"), F.lit(1).cast("long").alias("size"), (F.col("start") + start + F.col("place")).alias("place"))
    return found.select("uri", "depth", "size", "place").unionByName(hung)
