"""Stateful gates of streams: equal to the batch gates, restarted, and reading no history."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rowforge.operators import generate
from rowforge.streaming import gates, intake

ROW = "label string, ord long, title string, description string, keywords string"


def candidates(n=240, seed=3):
    """Repeats within and across batches, texts that do not fit, a hot label, a label that nobody asked for."""
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "a", "a", "b", "c"]), i, f"T{rng.randrange(40)}", "long enough" if rng.random() < 0.9 else "x", "k; me@example.org" if i % 50 == 0 else "k")
        for i in range(n)
    ]


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("label", "ord", "title", "description", "keywords"), r, strict=True))) + "\n" for r in rows))


def run(spark, tmp_path, needed, files_per_batch=1):
    from pyspark.sql.types import StructType

    stream = intake.read_candidates(spark, str(tmp_path / "in"), StructType.fromDDL(ROW), files_per_batch).drop("_corrupt_record")
    intake.run_gates(stream, str(tmp_path / "out"), str(tmp_path / "state"), (5, 50), needed)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture(scope="module")
def needed(spark):
    return spark.createDataFrame([("a", 12), ("b", 5)], "label string, needed long")


def test_batches_equal_one_batch_over_everything(spark, tmp_path, needed):
    rows = candidates()
    want = generate.quota_gate(generate.cheap_gates(spark.createDataFrame(rows, ROW), (5, 50)), needed)
    want = sorted(tuple(r) for r in want.select("label", "ord", "title", "description", "keywords", "verdict").collect())
    for i in range(2):
        part = rows[80 * i : 80 * (i + 1)]
        random.Random(i).shuffle(part)
        write(tmp_path / "in", f"{i}.json", part)
    run(spark, tmp_path, needed)
    write(tmp_path / "in", "2.json", rows[160:])  # a restart from the checkpoint
    out = run(spark, tmp_path, needed)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert run(spark, tmp_path, needed).count() == len(rows)  # nothing new, nothing done
    assert {r["verdict"] for r in out.where("label = 'c' and description <> 'x'").collect()} <= {"over_quota", "discarded_duplicate"}
    states = {}
    for operator in (0, 1):
        try:
            read = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("operatorId", operator).option("stateVarName", "kept").load()
            states.update({r["key"]["label"]: r["value"]["n"] for r in read.collect()})
        except Exception:  # the other operator has no such state
            continue
    assert states == {"a": 12, "b": 5}


def test_first_of_all_batches(spark, tmp_path):
    from pyspark.sql.types import StructType

    seen = []
    for i in range(3):
        part = [("a", 100 * i + k, f"T{(7 * i + k) % 12}", "d", "k") for k in range(8)]
        seen += [r[2] for r in part]
        write(tmp_path / "in", f"{i}.json", part)
        stream = intake.read_candidates(spark, str(tmp_path / "in"), StructType.fromDDL(ROW)).drop("_corrupt_record")
        intake.finish(intake.dedupe(stream.select("title"), ["title"]), str(tmp_path / "out"), str(tmp_path / "state"))
    out = [r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(out) == sorted(set(seen))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_a_batch_reads_no_earlier_output(spark, tmp_path, needed):
    """Once a batch is done its output may go; the gates still know what was kept and seen."""
    rows = candidates(120, seed=8)
    want = generate.quota_gate(generate.cheap_gates(spark.createDataFrame(rows, ROW), (5, 50)), needed)
    want = sorted((r["ord"], r["verdict"]) for r in want.collect())
    write(tmp_path / "in", "0.json", rows[:70])
    first = sorted((r["ord"], r["verdict"]) for r in run(spark, tmp_path, needed).collect())
    for part in (tmp_path / "out").glob("part-*"):
        part.unlink()
    write(tmp_path / "in", "1.json", rows[70:])
    from pyspark.sql.types import StructType

    stream = intake.read_candidates(spark, str(tmp_path / "in"), StructType.fromDDL(ROW), 1).drop("_corrupt_record")
    intake.finish(gates.gated(stream, (5, 50), needed), str(tmp_path / "later"), str(tmp_path / "state"))
    later = sorted((r["ord"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "later" / "part-*.parquet")).select(F.col("ord"), F.col("verdict")).collect())
    assert sorted(first + later) == want
