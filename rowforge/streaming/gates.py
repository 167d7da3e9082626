"""Stateful gates of a continuous intake: exact deduplication and quotas whose cost does not grow with what came before.

Both keep their state in the state store of RocksDB, which lives on disk, finds a key by Bloom filters and sorted files
and merges what a batch adds; memory is bounded by setting. A batch reads the keys that its own rows ask for and
nothing else. On a restart the checkpoint brings back the state as the last whole batch left it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rowforge.functions.text import cell, scrub
from rowforge.operators.generate import sample_print

#: Groups of contents that share a state; a batch's rows of a group are looked up together.
BUCKETS = 256
_ROW = "label string, ord long, title string, description string, keywords string"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def use_disk_state(spark: SparkSession) -> None:
    """Stateful streams of this session keep their state on disk, in memory bounded for each executor."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)


class FirstOfContent(StatefulProcessor):
    """Of the rows that passed so far the first of each content passes; a content seen in an earlier batch never does.

    Of a batch's rows with one content the smallest ord is first. Rows are looked at as they come: one row of each
    content is held.
    """

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "print string", "ord long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple] = {}
        columns: list[str] = []
        for part in rows:
            columns, out = list(part.columns), []
            at = {c: i for i, c in enumerate(columns)}
            for row in part.itertuples(index=False, name=None):
                if row[at["verdict"]] != "passed":
                    out.append(row)
                    continue
                content = row[at["print"]]
                held = first.get(content)
                if held is None:
                    first[content] = row
                else:
                    earlier, later = (row, held) if row[at["ord"]] < held[at["ord"]] else (held, row)
                    first[content] = earlier
                    out.append(tuple("discarded_duplicate" if c == "verdict" else v for c, v in zip(columns, later, strict=True)))
            yield pd.DataFrame(out, columns=columns).drop(columns=["bucket"])
        fresh = []
        for content, row in first.items():
            known = self.seen.containsKey((content,))
            if not known:
                self.seen.updateValue((content,), (int(row[columns.index("ord")]),))
            fresh.append(tuple("discarded_duplicate" if c == "verdict" and known else v for c, v in zip(columns, row, strict=True)))
        if fresh:
            yield pd.DataFrame(fresh, columns=columns).drop(columns=["bucket"])

    def close(self) -> None:
        pass


class Quota(StatefulProcessor):
    """A label's passed rows in the order of ord, batch after batch, until it has what it needs; the others are over_quota.

    The state of a label is how many rows it kept and how many each gate discarded. As many rows of a batch are held as
    the label still needs.
    """

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "n long")
        self.discards = handle.getMapState("discards", "verdict string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = int(self.kept.get()[0]) if self.kept.exists() else 0
        held: list[tuple] = []  # a heap with the largest ord on top
        counts: dict[str, int] = {}
        columns: list[str] = []
        arrived = 0
        for part in rows:
            columns, out = list(part.columns), []
            at = {c: i for i, c in enumerate(columns)}

            def over(row: tuple, columns: list[str] = columns) -> tuple:
                return tuple("over_quota" if c == "verdict" else v for c, v in zip(columns, row, strict=True))

            for row in part.itertuples(index=False, name=None):
                arrived += 1
                if row[at["verdict"]] != "passed":
                    out.append(row)
                    continue
                needed = row[at["needed"]]
                left = (0 if pd.isna(needed) else int(needed)) - kept
                if left > len(held):
                    heapq.heappush(held, (-row[at["ord"]], arrived, row))
                elif held and left > 0 and row[at["ord"]] < -held[0][0]:
                    out.append(over(heapq.heapreplace(held, (-row[at["ord"]], arrived, row))[2]))
                else:
                    out.append(over(row))
            for row in out:
                counts[row[at["verdict"]]] = counts.get(row[at["verdict"]], 0) + 1
            yield pd.DataFrame(out, columns=columns).drop(columns=["needed"])
        if held:
            self.kept.update((kept + len(held),))
            yield pd.DataFrame([row for *_, row in sorted(held, key=lambda h: -h[0])], columns=columns).drop(columns=["needed"])
        for verdict, n in counts.items():
            before = self.discards.getValue((verdict,))[0] if self.discards.containsKey((verdict,)) else 0
            self.discards.updateValue((verdict,), (int(before) + n,))

    def close(self) -> None:
        pass


def gated(stream: DataFrame, corridor: tuple[int, int], needed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The candidates (label, ord, title, description, keywords) of a stream with their verdict.

    The gates are those of the batch operators in their order: length, exact duplicate, quota. `needed` is a static
    table of label and needed; a label without a row needs none. Within a batch rows are taken in the order of ord, so
    that the result is that of one batch over everything if batches come in that order. A null label is one too.
    """
    use_disk_state(stream.sparkSession)
    fits = F.length(cell("description")).between(*corridor)
    content = sample_print(cell("title"), cell("description"))
    rows = stream.select(
        cell("label").alias("label"), F.col("ord").cast("long").alias("ord"), *[cell(c).alias(c) for c in ("title", "description", "keywords")],
        F.when(fits, "passed").otherwise("discarded_length").alias("verdict"), F.md5(content).alias("print"),
    )
    # What the length gate discards needs no look at its content: it is dealt by its place.
    dealt = rows.withColumn("bucket", F.pmod(F.when(F.col("verdict") == "passed", F.xxhash64("print")).otherwise(F.xxhash64("ord")), F.lit(buckets)).cast("int"))
    first = dealt.groupBy("bucket").transformWithStateInPandas(FirstOfContent(), f"{_ROW}, verdict string, print string", "Append", "None")
    wanted = needed.groupBy(cell("label").alias("label")).agg(F.max("needed").cast("long").alias("needed"))
    counted = first.drop("print").join(wanted, "label", "left").select("label", "ord", "title", "description", "keywords", "verdict", "needed")
    out = counted.groupBy("label").transformWithStateInPandas(Quota(), f"{_ROW}, verdict string", "Append", "None")
    return out.select("label", "ord", *[scrub(F.col(c)).alias(c) for c in ("title", "description", "keywords")], "verdict")


def first_seen(stream: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of each content of all batches, exactly, without an event time; contents are kept on disk."""
    use_disk_state(stream.sparkSession)
    return stream.dropDuplicates(columns)
