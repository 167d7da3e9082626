"""Queries: streaming intake, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowforge.plans.catalog import register
from rowforge.session import read_table, shared_folder
from rowforge.streaming import intake


def _events(spark, d):
    """The events as JSON-lines files in the shared folder, one line of each file spoiled, read as a stream."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = read_table(spark, d, "events")
    kind = rows.schema
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.write.text(f"{path}/in")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{path}/in")
    return intake.read_candidates(spark, f"{path}/in", kind), path


@register("str1_stateless_gates", "SELECT event_id, event_type FROM events WHERE length(event_type) BETWEEN 4 AND 6")
def _(spark, d):
    stream, path = _events(spark, d)
    intake.finish(intake.stateless_gates(stream, "event_type", (4, 6)).select("event_id", "event_type"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("str2_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    stream, path = _events(spark, d)
    intake.finish(intake.dedupe(stream.where("_corrupt_record IS NULL").select("user_id", "event_type"), ["user_id", "event_type"]), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("str3_quota", "SELECT event_type AS label, least(200, count(DISTINCT user_id)) AS kept FROM events GROUP BY event_type")
def _(spark, d):
    stream, path = _events(spark, d)
    rows = stream.where("_corrupt_record IS NULL").select(
        F.col("event_type").alias("label"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"),
        F.concat(F.lit("user "), "user_id").alias("description"), F.lit("").alias("keywords"),
    )
    needed = read_table(spark, d, "events").select(F.col("event_type").alias("label")).distinct().withColumn("needed", F.lit(200).cast("long"))
    intake.run_batch_gates(rows, f"{path}/out", f"{path}/state", (1, 100), needed).awaitTermination()
    done = spark.read.parquet(f"{path}/out").where("verdict = 'passed'")
    return done.groupBy("label").agg(F.count("*").alias("kept"))


@register("str4_leakage_gate", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark, d):
    stream, path = _events(spark, d)
    reference = read_table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    left = intake.without_leaks(stream.where("_corrupt_record IS NULL").select("event_id", "user_id"), reference, "user_id")
    intake.finish(left.select("event_id"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("str3_quota_state", """WITH e AS (SELECT event_type AS label, user_id, length('user ' || user_id) <= 7 AS fits FROM events),
c AS (SELECT label, count(*) FILTER (WHERE NOT fits) AS long, count(*) FILTER (WHERE fits) AS f, count(DISTINCT user_id) FILTER (WHERE fits) AS u FROM e GROUP BY label)
SELECT label, verdict, items FROM (SELECT label, unnest(['discarded_length', 'discarded_duplicate', 'passed', 'over_quota']) AS verdict,
    unnest([long, f - u, least(u, 60), greatest(u - 60, 0)]) AS items FROM c) WHERE items > 0""")
def _(spark, d):
    stream, path = _events(spark, d)
    rows = stream.where("_corrupt_record IS NULL").select(
        F.col("event_type").alias("label"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"),
        F.concat(F.lit("user "), "user_id").alias("description"), F.lit("").alias("keywords"),
    )
    needed = read_table(spark, d, "events").select(F.col("event_type").alias("label")).distinct().withColumn("needed", F.lit(60).cast("long"))
    intake.run_gates(rows, f"{path}/out", f"{path}/state", (1, 7), needed)
    return spark.read.parquet(f"{path}/out").groupBy("label", "verdict").agg(F.count("*").alias("items"))
