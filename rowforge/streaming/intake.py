"""Continuous intake of candidates: stateless gates, deduplication, quotas, leakage, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.text import cell, pii_counts, scrub
from rowforge.operators.generate import cheap_gates, quota_gate
from rowforge.streaming.gates import first_seen, gated

_BAD = "_corrupt_record"


def read_candidates(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream over JSON-lines files; a line that is no record keeps its text in _corrupt_record."""
    shape = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    reader = spark.readStream.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(folder)


def stateless_gates(stream: DataFrame, text: str, corridor: tuple[int, int]) -> DataFrame:
    """Candidates inside the corridor with personal data masked; how many lines were corrupt is observed as `corrupt`."""
    found = pii_counts(cell(text))
    out = stream
    if _BAD in stream.columns:
        out = out.observe("intake", F.count("*").alias("lines"), F.count_if(F.col(_BAD).isNotNull()).alias("corrupt"))
        out = out.where(F.col(_BAD).isNull()).drop(_BAD)
    hits = found["email"] + found["url"] + found["phone"] + found["handle"]
    out = out.withColumn("pii", hits).where(F.length(cell(text)).between(*corridor))
    return out.withColumn(text, scrub(cell(text)))


def dedupe(stream: DataFrame, columns: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first of each content; with an event time the state is bounded, and repeats after `delay` pass again.

    Without one the contents are kept on disk, and no repeat ever passes.
    """
    if event_time is None:
        return first_seen(stream, columns)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)


def without_leaks(stream: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not in a static reference; Spark broadcasts it only where it is small."""
    return stream.join(reference.select(column).distinct(), column, "left_anti")


def run_batch_gates(stream: DataFrame, path: str, checkpoint: str, corridor: tuple[int, int], needed: DataFrame):
    """Every batch through the batch gates against all that was accepted before; a repeated batch changes nothing.

    This is the way for gates that need the whole history as a table; each batch reads it. run_gates() does not.

    A batch writes to path/batch=N, replacing what an interrupted attempt left there; what earlier batches
    wrote is the history. Returns the started query.
    """
    spark = stream.sparkSession
    columns = "label string, ord long, title string, description string, keywords string, verdict string, batch long"

    def work(rows: DataFrame, batch: int) -> None:
        try:
            past = spark.read.schema(columns).option("basePath", path).parquet(path).where(F.col("batch") < batch)
        except Exception as problem:  # before the first batch there is no folder
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            past = spark.createDataFrame([], columns)
        kept = past.where("verdict = 'passed'").groupBy("label").agg(F.count("*").alias("kept"))
        left = needed.join(kept, "label", "left").select("label", (F.col("needed") - F.coalesce("kept", F.lit(0))).alias("needed"))
        seen = past.where("verdict <> 'discarded_length'")
        verdicts = quota_gate(cheap_gates(rows, corridor, seen), left)
        verdicts.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_gates(stream: DataFrame, path: str, checkpoint: str, corridor: tuple[int, int], needed: DataFrame) -> None:
    """What is there now through the stateful gates into a Parquet folder; a restart goes on where it ended.

    A batch costs what its own rows cost: earlier output is not read.
    """
    finish(gated(stream, corridor, needed), path, checkpoint)


def finish(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is there now to a Parquet folder; a restart goes on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
