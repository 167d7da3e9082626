"""Balancing of labels as table work: plan, examples, prompts, gates, assembly.

The model is a batch hook: the prompts table goes in, a table of answers comes out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.fields import EXAMPLE_FOR, GENERATED_FOR, MARKS, TextField, add_mark, fingerprint, is_marked, one_line, typical_phrases
from rowforge.functions.text import cell, fold_case, name, scrub, split_labels
from rowforge.operators.labels import edges

EXTRA_BATCHES, EXAMPLE_CHARS, MAX_VALUE, FLOOR_CAP = 2, 400, 2000, 40
MAX_OUTPUT_TOKENS, BASE_TOKENS = 16_000, 500


def plan(df: DataFrame, row: str, label: str, target: int, separator: str = ",", batch: int | Column = 10, limit: int | None = None) -> DataFrame:
    """A row for each label: support, deficit, planned, batches, max_batches, synthetic_share, skipped.

    The shortest labels come first: `limit` is used up in the order of support, then label. A label in
    deficit without an unmarked row is skipped.
    """
    made = is_marked(GENERATED_FOR) if GENERATED_FOR in df.columns else F.lit(False)
    each = edges(df.withColumn("_made", made), row, label, separator)
    marks = df.select(name(row).alias("row"), made.alias("made"))
    support = each.join(marks, "row").groupBy("label").agg(F.count("*").alias("support"), F.count_if("made").alias("made"))
    deficit = F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("support"))
    table = support.withColumn("deficit", deficit).withColumn("skipped", (F.col("deficit") > 0) & (F.col("made") == F.col("support")))
    wanted = F.when(F.col("skipped"), F.lit(0)).otherwise(F.col("deficit"))
    table = table.withColumn("_wanted", wanted.cast("long"))
    if limit is None:
        table = table.withColumn("planned", F.col("_wanted"))
    else:
        before = Window.orderBy("support", "label").rowsBetween(Window.unboundedPreceding, -1)  # over labels
        used = F.coalesce(F.sum("_wanted").over(before), F.lit(0))
        table = table.withColumn("planned", F.greatest(F.lit(0).cast("long"), F.least(F.col("_wanted"), F.lit(limit) - used)))
    batches = F.ceil(F.col("planned") / (F.lit(batch) if isinstance(batch, int) else batch)).cast("long")
    share = F.round((F.col("made") + F.col("planned")) / (F.col("support") + F.col("planned")), 3)
    table = table.withColumn("batches", batches)
    most = F.when(F.col("planned") > 0, F.col("batches") + EXTRA_BATCHES).otherwise(F.lit(0)).cast("long")
    return table.select("label", "support", "deficit", "planned", "batches", most.alias("max_batches"), share.alias("synthetic_share"), "skipped")


def totals(planned: DataFrame, target: int) -> DataFrame:
    """One row: rows_to_add, batches, max_batches, labels_below_target, labels cut by the limit, labels skipped."""
    live = ~F.col("skipped")
    return planned.agg(
        F.lit(target).alias("target_per_label"),
        F.coalesce(F.sum("planned"), F.lit(0)).alias("rows_to_add"),
        F.coalesce(F.sum("batches"), F.lit(0)).alias("batches"),
        F.coalesce(F.sum("max_batches"), F.lit(0)).alias("max_batches"),
        F.count_if(live & (F.col("deficit") > 0)).alias("labels_below_target"),
        F.count_if(live & (F.col("planned") < F.col("deficit"))).alias("labels_cut_by_limit"),
        F.count_if("skipped").alias("skipped_without_examples"),
    )


def check_budget(planned: DataFrame, max_calls: int) -> None:
    """Refuse a plan whose worst case makes more calls than allowed, before the first one."""
    calls = planned.agg(F.coalesce(F.sum("max_batches"), F.lit(0))).first()[0]
    if calls > max_calls:
        raise ValueError(f"The plan may make {calls} calls; {max_calls} are allowed.")


def foreign_marks(df: DataFrame, row: str, label: str, separator: str = ",") -> DataFrame:
    """One row: how many generated_for marks are no label of this column, and the smallest of them."""
    marks = df.where(is_marked(GENERATED_FOR)).select(F.trim(cell(GENERATED_FOR)).alias("label"))
    known = edges(df, row, label, separator).select("label").distinct()
    return marks.join(known, "label", "left_anti").agg(F.count("*").alias("rows"), F.min("label").alias("example"))


def pick_examples(df: DataFrame, row: str, label: Column, fields: list[TextField], k: int = 4, touched: Column | None = None) -> DataFrame:
    """(label, rank, row): rows that show a label best.

    Untouched rows first, complete ones first, then nearest to the median length of the complete untouched
    rows (else the untouched, the complete, all), the longer one first; no content twice.
    """
    cells = [f.normal() for f in fields]
    size = reduce(lambda a, b: a + b, [F.length(c) for c in cells])
    whole = reduce(lambda a, b: a & b, [c != "" for c in cells])
    touched = F.lit(False) if touched is None else touched
    read = df.select(
        name(row).alias("row"), F.explode(label).alias("label"), size.alias("size"), whole.alias("whole"), touched.alias("touched"),
        F.md5(fingerprint(fields)).alias("print"),
    )
    clean, full = ~F.col("touched"), F.col("whole")
    half = F.lit(0.5)
    median = read.groupBy("label").agg(
        F.coalesce(
            F.percentile(F.when(clean & full, F.col("size")), half),
            F.percentile(F.when(clean, F.col("size")), half),
            F.percentile(F.when(full, F.col("size")), half),
            F.percentile("size", half),
        ).alias("median")
    )
    order = [F.col("touched"), ~F.col("whole"), F.abs(F.col("size") - F.col("median")), F.desc("size"), F.col("row")]
    read = read.join(median, "label")
    once = F.row_number().over(Window.partitionBy("label", "print").orderBy(*order))
    read = read.withColumn("_n", once).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return read.withColumn("rank", rank).where(F.col("rank") <= k).select("label", "rank", "row")


def shown(field: TextField) -> Column:
    """A cell as a prompt shows it."""
    return F.substring(field.normal(), 1, EXAMPLE_CHARS)


def entry_sizes(df: DataFrame, row: str, examples: DataFrame, fields: list[TextField]) -> DataFrame:
    """(label, entry_tokens, per_call of 10, min_chars of each single-valued field) from the examples shown."""
    lengths = [F.length(shown(f)).alias(f"n{i}") for i, f in enumerate(fields)]
    read = examples.join(df.select(name(row).alias("row"), *lengths), "row")
    longest = F.max(reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(fields))]))
    floors = []
    for i, f in enumerate(fields):
        least = F.floor(F.min(F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))) / 4)
        floors.append((F.lit(0).cast("long") if f.separator else F.coalesce(F.least(least, F.lit(FLOOR_CAP).cast("long")), F.lit(0).cast("long"))).alias(f"min_chars_{f.column}"))
    tokens = F.greatest(F.lit(300).cast("long"), F.floor(longest / 2))
    return read.groupBy("label").agg(tokens.alias("entry_tokens"), *floors)


def per_call(tokens: Column, batch: int = 10) -> Column:
    """Entries of one call that the output has room for."""
    fits = F.floor((F.lit(MAX_OUTPUT_TOKENS - BASE_TOKENS)) / tokens)
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(batch).cast("long"), fits))


def output_budget(tokens: Column, entries: Column) -> Column:
    return F.least(F.lit(MAX_OUTPUT_TOKENS).cast("long"), F.lit(BASE_TOKENS) + entries * tokens)


AVOIDED = 15


def field_lines(fields: list[TextField], shapes: list[DataFrame], labels: DataFrame) -> DataFrame:
    """(label, lines): each field with its kind, guidance and usual size; `shapes` as field_shapes() gives them, one a field."""
    out, parts = labels.select("label").distinct(), []
    for i, (f, shape) in enumerate(zip(fields, shapes, strict=True)):
        if f.separator is None:
            kind = "free text, ONE value"
        else:
            kind = f'list in ONE string, separated by "{f.separator}"' + (f"; at least {f.min_values} values" if f.min_values > 1 else "")
        names = ("chars_low", "chars_high", "values_low", "values_high")
        out = out.join(shape.select("label", *[F.col(n).alias(f"s{i}_{n}") for n in names]), "label", "left")
        typical = typical_phrases(f, *[F.col(f"s{i}_{n}") for n in names])
        size = F.when(typical != "", F.concat(F.lit("; "), typical)).otherwise("")
        parts.append(F.concat(F.lit(f"{i + 1}. {f.column}{f' — {f.guidance}' if f.guidance else ''} ({kind}"), size, F.lit(")")))
    return out.select("label", F.concat_ws("\n", *parts).alias("lines"))


def avoided(df: DataFrame, row: str, label: Column, field: TextField, most: int = AVOIDED) -> DataFrame:
    """(label, avoid): the last `most` values of a label's rows in the first field, in row order, that new ones must not repeat."""
    read = df.select(name(row).alias("row"), F.explode(label).alias("label"), one_line(shown(field)).alias("value")).where("value <> ''")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("row")))
    read = read.withColumn("n", place).where(F.col("n") <= most)
    values = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: x["value"])
    return read.groupBy("label").agg(F.array_join(values, "; ").alias("avoid"))


def prompts(
    df: DataFrame, row: str, planned: DataFrame, examples: DataFrame, contrast: DataFrame, fields: list[TextField], batch: int = 10,
    shapes: list[DataFrame] | None = None, avoid: DataFrame | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """(label, call, n, max_tokens, prompt): a row for each planned call.

    The prompt has examples, the labels to stay apart from (with the number of those beyond the list, where `contrast`
    has `more`), the fields with their usual sizes (`shapes`) and what must not be repeated (`avoid`). With `sizes`, as
    entry_sizes() gives them, a call asks for no more entries than its output has room for.
    """
    lines = F.concat_ws(" | ", *[F.concat(F.lit(f"{f.column}: "), one_line(shown(f))) for f in fields])
    told = examples.join(df.select(name(row).alias("row"), lines.alias("line")), "row").groupBy("label")
    told = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("examples"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), "; ")
    more = F.max("more") if "more" in contrast.columns else F.lit(0)
    apart = contrast.groupBy("label").agg(listed.alias("apart"), more.alias("more"))
    calls = planned.where("planned > 0").select("label", "planned")
    tokens = F.lit(None).cast("long")
    if sizes is not None:
        calls = calls.join(sizes.select("label", "entry_tokens"), "label", "left")
        tokens = F.coalesce("entry_tokens", F.lit(300).cast("long"))
        calls = calls.withColumn("size", per_call(tokens, batch))
    else:
        calls = calls.withColumn("size", F.lit(batch).cast("long"))
    calls = calls.withColumn("call", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("planned") / F.col("size")) - 1, F.lit(0)).cast("int"))))
    n = F.least(F.col("size"), F.col("planned") - F.col("call") * F.col("size"))
    guide = "; ".join(f"{f.column}: {f.guidance}" for f in fields if f.guidance and shapes is None)
    out = calls.join(told, "label", "left").join(apart, "label", "left")
    described: Column = F.lit("")
    if shapes is not None:
        out = out.join(field_lines(fields, shapes, calls), "label", "left")
        described = F.concat(F.lit("\nFields:\n"), F.coalesce("lines", F.lit("")))
    kept_off: Column = F.lit("")
    if avoid is not None:
        out = out.join(avoid, "label", "left")
        kept_off = F.concat(F.lit("\nNot to be repeated: "), F.coalesce("avoid", F.lit("—")))
    rest = F.when(F.col("more") > 0, F.concat(F.lit(" (and "), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(
        F.lit("Write "), n.cast("string"), F.lit(" new entries for '"), F.col("label"), F.lit("'.\nExamples:\n"), F.coalesce("examples", F.lit("")),
        F.lit("\nNot to be confused with: "), F.coalesce("apart", F.lit("")), rest, described, kept_off, F.lit(f"\n{guide}" if guide else ""),
    )
    budget = output_budget(tokens, n) if sizes is not None else F.lit(MAX_OUTPUT_TOKENS).cast("long")
    return out.select("label", "call", n.alias("n"), budget.alias("max_tokens"), text.alias("prompt"))


def gate(answers: DataFrame, fields: list[TextField], floors: DataFrame | None = None, known: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Answers (label, ord, one column for each field) with `verdict`: accepted, a discard reason, or over_quota.

    In this order: incomplete, short, long, duplicate of `known` prints or an earlier answer that passed the
    gates before. Cells come back scrubbed and in their written form.
    """
    clean = [TextField(f.column, f.separator, f.min_values).values(scrub(cell(f.column))) for f in fields]
    out = answers.withColumns({f"_v{i}": v for i, v in enumerate(clean)})
    out = out.withColumns({f.column: f.write(F.col(f"_v{i}")) for i, f in enumerate(fields)})
    incomplete = reduce(lambda a, b: a | b, [F.size(f"_v{i}") < f.min_values for i, f in enumerate(fields)])
    short = F.lit(False)
    if floors is not None:
        out = out.join(floors, "label", "left")
        for f in fields:
            short = short | (F.length(name(f.column)) < F.coalesce(name(f"min_chars_{f.column}"), F.lit(0)))
    long = reduce(lambda a, b: a | b, [F.length(name(f.column)) > MAX_VALUE for f in fields])
    early = F.when(incomplete, "discarded_incomplete").when(short, "discarded_short").when(long, "discarded_long")
    out = out.withColumn("_early", early).withColumn("_print", F.md5(fold_case(F.concat_ws("\n", *[name(f.column) for f in fields]))))
    if known is not None:
        seen = known.select(F.col("print").alias("_print")).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, "_print", "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean"))
    passed = F.col("_early").isNull()
    first = F.row_number().over(Window.partitionBy("_print", passed).orderBy("ord"))
    again = F.coalesce("_seen", F.lit(False)) | (first > 1)
    out = out.withColumn("verdict", F.coalesce("_early", F.when(again, "discarded_duplicate")))
    place = F.row_number().over(Window.partitionBy("label", F.col("verdict").isNull()).orderBy("ord"))
    if wanted is not None:
        out = out.join(wanted.select("label", F.col("planned").alias("_most")), "label", "left")
        out = out.withColumn("verdict", F.coalesce("verdict", F.when(place > F.coalesce("_most", F.lit(0)), "over_quota")))
    out = out.withColumn("verdict", F.coalesce("verdict", F.lit("accepted")))
    return out.select("label", "ord", *[name(f.column) for f in fields], "verdict")


def prints(df: DataFrame, fields: list[TextField]) -> DataFrame:
    """The duplicate gate's identities of a table's rows."""
    return df.select(F.md5(fingerprint(fields)).alias("print"))


def assemble(df: DataFrame, row: str, accepted: DataFrame, examples: DataFrame, label: str, separator: str = ",") -> DataFrame:
    """The table with its examples marked and the accepted rows appended, each marked with its label."""
    marked = df
    for mark in MARKS:
        marked = marked.withColumn(mark, F.when(is_marked(mark), cell(mark)).otherwise("") if mark in df.columns else F.lit(""))
    told = examples.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("_for"))
    marked = marked.join(told, name(row) == told["row"], "left") if row != "row" else marked.join(told, "row", "left")
    both = F.aggregate(F.coalesce("_for", F.array().cast("array<string>")), cell(EXAMPLE_FOR), lambda s, x: add_mark(s, x, separator))
    marked = marked.withColumn(EXAMPLE_FOR, both).select(*[name(c) for c in dict.fromkeys([*df.columns, *MARKS])])
    new = accepted.withColumnsRenamed({"label": "_label"}).withColumn(label, F.col("_label")).withColumn(GENERATED_FOR, F.col("_label"))
    added = [cell(c).alias(c) if c in new.columns else F.lit("").alias(c) for c in marked.columns]
    return marked.select(*[cell(c).alias(c) for c in marked.columns]).unionByName(new.select(*added))
