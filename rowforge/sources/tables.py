"""Reading and writing of text tables: CSV, JSON, JSON lines, named datasets with a history."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.text import as_text_table, cell, combined_text, name, pii_counts, scrub, split_labels

_BAD = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, separator: str = ";", encoding: str = "utf-8") -> DataFrame:
    """Every cell as text, missing ones empty."""
    options = {"header": True, "sep": separator, "encoding": encoding, "multiLine": True, "escape": '"', "inferSchema": False, "nullValue": ""}
    df = spark.read.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    if not df.columns:
        raise ValueError("The file is empty.")
    return as_text_table(df)


def _scalar(column, kind: T.DataType):
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(F.size(column) > 0, F.to_json(column)).otherwise("")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
    if isinstance(kind, T.MapType):
        return F.to_json(column)
    return column.cast("string")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as dot paths; lists of scalars joined by commas, other lists as JSON text."""
    out: list[tuple[str, object]] = []

    def walk(schema: T.StructType, column, prefix: str) -> None:
        for field in schema.fields:
            path = f"{prefix}{field.name}"
            inner = name(field.name) if column is None else column.getField(field.name)
            if isinstance(field.dataType, T.StructType) and field.dataType.fields:
                walk(field.dataType, inner, f"{path}.")
            else:
                out.append((path, F.coalesce(_scalar(inner, field.dataType), F.lit(""))))

    walk(df.schema, None, "")
    paths = [p for p, _ in out]
    clash = sorted({p for p in paths if paths.count(p) > 1})
    if clash:
        raise ValueError(f"Two fields have the path {', '.join(clash)}.")
    return df.select(*[c.alias(p) for p, c in out])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An object or an array of objects, flattened; anything else is refused."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if _BAD in df.columns:
        bad = df.where(F.col(_BAD).isNotNull()).limit(1).count() if len(df.columns) > 1 else 1
        if bad:
            raise ValueError("The file holds something other than objects.")
        df = df.drop(_BAD)
    return flatten(df)


def read_jsonl(spark: SparkSession, path: str, tolerant: bool = False, schema: T.StructType | None = None) -> tuple[DataFrame, int]:
    """(flattened records, lines skipped): a bad line is refused with its file and number, or skipped if `tolerant`."""
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    numbered = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_line"))
    lines = numbered.where(F.trim("value") != "")
    parsed = schema or spark.read.option("columnNameOfCorruptRecord", _BAD).json(path).schema
    fields = [f for f in parsed.fields if f.name != _BAD]
    shape = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
    read = lines.select("_file", "_start", "_line", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    bad = read.where(F.col(f"r.{_BAD}").isNotNull() | F.col("r").isNull())
    count = bad.count()
    if count and not tolerant:
        # The number within its file: lines of the splits before it, then lines of its own split.
        at = bad.agg(F.min(F.struct("_file", "_start", "_line")).alias("b")).first()["b"]
        of_file = numbered.where(F.col("_file") == at["_file"])
        before = of_file.where(F.col("_start") < at["_start"]).count()
        own = of_file.where((F.col("_start") == at["_start"]) & (F.col("_line") <= at["_line"])).count()
        raise ValueError(f"Line {before + own} of {at['_file']} is no JSON object.")
    good = read.where(F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull())
    return flatten(good.select(*[F.col("r").getField(f.name).alias(f.name) for f in fields])), count


def union_records(tables: list[DataFrame]) -> DataFrame:
    """All columns of all tables, missing cells empty."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [as_text_table(t) for t in tables])
    return both.fillna("")


#: Characters of records in a piece of a JSON array, and pieces of a file.
PIECE, PIECES = 1 << 20, 32


def _array_pieces(size: int, pieces: int):
    """The records of a partition as JSON arrays of `pieces` pieces each; a piece is a stretch of lines in one value."""

    def run(batches):
        made, held, length = 0, [], 0

        def piece(last: bool) -> pd.DataFrame:
            lead = "[" if made % pieces == 0 else ","
            return pd.DataFrame({"value": [lead + "\n,".join(held) + ("\n]" if last or made % pieces == pieces - 1 else "")]})

        for batch in batches:
            for record in batch["value"]:
                if length >= size:
                    yield piece(False)
                    made, held, length = made + 1, [], 0
                held.append(record)
                length += len(record)
        yield piece(True) if held else pd.DataFrame({"value": ["[]"]})

    return run


def write_table(df: DataFrame, path: str, kind: str = "csv", separator: str = ";", spreadsheet_safe: bool = False, gzip: bool = False) -> None:
    """CSV, JSON lines, or a JSON array in each part file; UTF-8, \\n line ends. write_json_array() makes one array of all.

    A JSON array can only be read by one task, so a part file has about PIECE * PIECES characters at most.
    """
    if spreadsheet_safe:
        df = defuse(df)
    if kind == "csv":
        writer = df.write.option("header", True).option("sep", separator).option("escape", '"').option("emptyValue", "")
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quoteAll", spreadsheet_safe)
        (writer.option("compression", "gzip") if gzip else writer).csv(path)
    elif kind == "jsonl":
        (df.write.option("compression", "gzip") if gzip else df.write).json(path)
    elif kind == "json":
        record = F.to_json(F.struct(*[name(c) for c in df.columns]), {"ignoreNullFields": "false"})
        df.select(record.alias("value")).mapInPandas(_array_pieces(PIECE, PIECES), "value string").write.option("maxRecordsPerFile", PIECES).text(path)
    else:
        raise ValueError(f"Unknown format {kind!r}.")


def write_json_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """Part files that are one JSON array when they are put together in the order of their names, a record a line.

    Tasks write their records with a comma ahead. The last step gives the first part that has any its opening bracket, by
    copying that one part, adds a part with the closing one, and moves the folder to its place; before that there is
    nothing at `path`, which must not exist. With `order` the records are in that order, else in the table's.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = place(path).getFileSystem(conf)
    if fs.exists(place(path)):
        raise ValueError(f"{path} exists already.")
    draft = f"{path.rstrip('/')}._draft-{uuid.uuid4().hex}"
    rows = df.orderBy(name(order)) if order else df
    record = F.to_json(F.struct(*[name(c) for c in df.columns]), {"ignoreNullFields": "false"})
    rows.select(F.concat(F.lit(","), record).alias("value")).write.text(draft)
    parts = sorted((f.getPath().getName() for f in fs.listStatus(place(draft)) if f.getPath().getName().startswith("part-") and f.getLen() > 0))
    if parts:
        source, target = fs.open(place(draft, parts[0])), fs.create(place(draft, "_head"))
        source.skip(1)
        target.write(ord("["))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 16, True)
        fs.delete(place(draft, parts[0]), False)
        fs.rename(place(draft, "_head"), place(draft, parts[0]))
    last = fs.create(place(draft, "part-end.txt"))
    last.write(bytearray(b"]\n" if parts else b"[]\n"))
    last.close()
    fs.rename(place(draft), place(path))


def read_json_array(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The records of write_json_array() as a text table of the given columns; missing cells are empty."""
    lines = spark.read.text(path).where(~F.col("value").isin("]", "[]"))
    shape = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return lines.select(F.from_json(F.substring("value", 2, 1 << 30), shape).alias("r")).select(*[F.coalesce(F.col("r").getField(c), F.lit("")).alias(c) for c in columns])


def defuse(df: DataFrame) -> DataFrame:
    """Cells and headers that a spreadsheet would read as a formula get an apostrophe."""
    risky = ["=", "+", "-", "@", "\t", "\r"]

    def safe(text):
        return F.when(F.substring(text, 1, 1).isin(risky), F.concat(F.lit("'"), text)).otherwise(text)

    return df.select(*[safe(cell(c)).alias(f"'{c}" if c[:1] in risky else c) for c in df.columns])


def ingest_reference(df: DataFrame, text: list[str], label: str, separator: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scrubbed table, PII counts by row totals, (label, count)); a label twice in a cell counts twice."""
    missing = [c for c in (*text, label) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}.")
    counts = [pii_counts(cell(c)) for c in text]
    kinds = ("email", "url", "phone", "handle")
    sums = {k: reduce(lambda a, b: a + b, [c[k] for c in counts]) for k in kinds}
    hit = reduce(lambda a, b: a + b, sums.values()) > 0
    report = df.agg(F.count("*").alias("rows_scanned"), F.count_if(hit).alias("rows_affected"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    groups = df.select(F.explode(split_labels(name(label), separator)).alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    return df.withColumns({c: scrub(cell(c)) for c in text}), report, groups


class Store:
    """Named Parquet datasets with a history below a folder that the cluster shares, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _check(self, dataset: str) -> str:
        if not dataset or not all(c.isalnum() or c in "-_." for c in dataset) or dataset.startswith("."):
            raise ValueError(f"{dataset!r} is no dataset name.")
        if dataset.endswith((".new", ".old")):
            raise ValueError("Names that end in .new or .old are kept for versions on their way.")
        return f"{self.root}/{dataset}"

    def exists(self, dataset: str) -> bool:
        return self._fs.exists(self._path(self._recover(dataset)))

    def save(self, df: DataFrame, dataset: str, source: str | None = None, operation: dict | None = None, overwrite: bool = False) -> dict:
        """Write the table, then its history, beside the old version, and swap; another name needs `overwrite`."""
        home = self._check(dataset)
        if self.exists(dataset) and dataset != source and not overwrite:
            raise ValueError(f"The dataset {dataset!r} exists.")
        past = self.history(source) if source and self.exists(source) else []
        entry = {**(operation or {}), "source": source, "at": datetime.now(UTC).isoformat()}
        fresh = f"{home}.new"
        self._fs.delete(self._path(fresh), True)
        df.write.parquet(f"{fresh}/data")
        lines = [json.dumps(e) for e in [*past, entry]]
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{fresh}/history")
        # The old version steps aside, the new one takes its place, then the old one goes: one of them is always there.
        old = f"{home}.old"
        self._fs.delete(self._path(old), True)
        if self._fs.exists(self._path(home)):
            self._move(home, old)
        self._move(fresh, home)
        self._fs.delete(self._path(old), True)
        return entry

    def _move(self, here: str, there: str) -> None:
        if not self._fs.rename(self._path(here), self._path(there)):
            raise OSError(f"{here} could not be moved to {there}.")

    def _recover(self, dataset: str) -> str:
        """The dataset's folder; a version that a broken save() left aside comes back."""
        home = self._check(dataset)
        if not self._fs.exists(self._path(home)) and self._fs.exists(self._path(f"{home}.old")):
            self._move(f"{home}.old", home)
        return home

    def load(self, dataset: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._recover(dataset)}/data")

    def history(self, dataset: str) -> list[dict]:
        return [json.loads(r["value"]) for r in self.spark.read.text(f"{self._recover(dataset)}/history").collect()]

    def preview(self, df: DataFrame) -> dict:
        """What saving would write; writes nothing."""
        return {"rows": df.count(), "columns": df.columns}

    def list(self) -> list[dict]:
        """Name, rows and columns of every dataset; counts come from the Parquet footers."""
        out = []
        if not self._fs.exists(self._path(self.root)):
            return out
        names = {s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))}
        for dataset in {n.removesuffix(".old") for n in names if not n.endswith(".new")}:
            df = self.load(dataset)
            out.append({"name": dataset, "rows": df.count(), "columns": df.columns})
        return sorted(out, key=lambda x: x["name"])

    def delete(self, dataset: str) -> bool:
        return self._fs.delete(self._path(self._check(dataset)), True)
