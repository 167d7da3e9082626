"""Enrichment of gaps: one prompt for each group of twins, answers joined back to all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.fields import ENRICHED_FIELDS, GENERATED_FOR, TextField, is_marked, label_name, merge_values, one_line, states_a_length, typical_phrase
from rowforge.functions.text import cell, name, scrub, split_labels
from rowforge.operators.combine import twin_key
from rowforge.operators.labels import field_shapes

MAX_VALUE, MAX_VALUES, MAX_LABELS = 2000, 50, 5


def target_of(fields: list[TextField], column: str) -> TextField:
    found = next((f for f in fields if f.column == column), None)
    if found is None:
        raise ValueError(f"The target {column!r} is not among the fields.")
    return found


def typical_sentence(df: DataFrame, target: TextField) -> str:
    """How long the field is in rows that people wrote; nothing where its guidance says so itself."""
    if states_a_length(target.guidance):
        return ""
    human = df
    if GENERATED_FOR in df.columns:
        human = human.where(~is_marked(GENERATED_FOR))
    if ENRICHED_FIELDS in df.columns:
        human = human.where(~F.array_contains(split_labels(name(ENRICHED_FIELDS)), target.column))
    r = field_shapes(human, target).first()
    chars = (r["chars_low"], r["chars_high"]) if r["chars_low"] is not None else None
    values = (r["values_low"], r["values_high"]) if r["values_low"] is not None else None
    phrase = typical_phrase(chars, values, target.separator is not None)
    return f" {phrase[0].upper()}{phrase[1:]}{' insgesamt' if target.separator else ''}." if phrase else ""


def gaps(df: DataFrame, row: str, fields: list[TextField], target: TextField, label: str | None = None, separator: str = ",", references: bool = True) -> DataFrame:
    """(row, twin) of the rows whose target cell is a gap."""
    key = twin_key([f.column for f in fields], label, separator, references)
    return df.where(target.is_gap()).select(name(row).alias("row"), key.alias("twin"))


def prompts(
    df: DataFrame, row: str, fields: list[TextField], column: str, label: str | None = None, names: DataFrame | None = None,
    separator: str = ",", limit: int = 5000, typical: str = "", references: bool = True,
) -> DataFrame:
    """(twin, row, prompt) for the first row of each group of twins with a gap, at most `limit` in row order."""
    target = target_of(fields, column)
    first = gaps(df, row, fields, target, label, separator, references).groupBy("twin").agg(F.min("row").alias("row"))
    first = first.orderBy("row").limit(limit)
    context = []
    for f in fields:
        if f.column != column:
            text = F.concat(F.lit(f'{f.column}: "'), one_line(f.normal()), F.lit('"'))
            context.append(F.when(F.size(f.values()) > 0, text))
    held = F.when(F.size(target.values()) > 0, F.concat(F.lit("Already there, not to be repeated: "), one_line(target.normal())))
    read = df.select(name(row).alias("row"), F.concat_ws("\n", *context, held).alias("context"))
    task = f"Write the field '{column}'.{typical}{' ' + target.guidance if target.guidance else ''}"
    out = first.join(read, "row")
    filed: Column = F.lit("")
    if label is not None:
        each = df.select(name(row).alias("row"), F.posexplode(F.slice(split_labels(name(label), separator), 1, MAX_LABELS)).alias("p", "label"))
        each = each.join(names, "label", "left") if names is not None else each.withColumn("name", F.lit(None).cast("string"))
        each = each.select("row", F.struct("p", label_name(F.col("label"), F.col("name")).alias("n")).alias("s"))
        each = each.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["n"]), ", ").alias("filed"))
        out = out.join(each, "row", "left")
        filed = F.when(F.coalesce("filed", F.lit("")) != "", F.concat(F.lit("Filed under: "), F.col("filed"), F.lit("\n"))).otherwise("")
    return out.select("twin", "row", F.concat(filed, F.col("context"), F.lit(f"\n{task}")).alias("prompt"))


def apply_answers(df: DataFrame, row: str, fields: list[TextField], column: str, answers: DataFrame, label: str | None = None, separator: str = ",", references: bool = True) -> DataFrame:
    """Gap cells with the answers (twin, values: array) of their twins, and the field's mark where a cell changed."""
    target = target_of(fields, column)
    found = gaps(df, row, fields, target, label, separator, references).join(answers.select("twin", "values"), "twin")
    parts = F.flatten(F.transform("values", lambda v: target.values(scrub(cell(v)))))
    parts = parts if target.separator else F.slice(parts, 1, 1)
    parts = F.slice(F.filter(parts, lambda v: F.length(v) <= MAX_VALUE), 1, MAX_VALUES)
    found = found.select(F.col("row").alias("_row"), parts.alias("_new"))
    out = df.join(found, name(row) == F.col("_row"), "left")
    held = target.values()
    merged = merge_values(held, F.col("_new")) if target.separator else F.col("_new")
    changed = F.col("_new").isNotNull() & (F.size(merged) > 0) & ~F.array_join(merged, "\x1f").eqNullSafe(F.array_join(held, "\x1f"))
    before = cell(ENRICHED_FIELDS) if ENRICHED_FIELDS in df.columns else F.lit("")
    mark = F.array_join(F.array_union(split_labels(before), F.array(F.lit(column))), ",")
    made = {column: F.when(changed, target.write(merged)).otherwise(name(column)), ENRICHED_FIELDS: F.when(changed, mark).otherwise(before)}
    return out.select(*[made[c].alias(c) if c in made else name(c) for c in dict.fromkeys([*df.columns, ENRICHED_FIELDS])])


def run_hook(prompted: DataFrame, complete, key: str, partitions: int = 8) -> DataFrame:
    """Answers (key, values) of an injected function prompt -> list of strings, in Arrow batches on the executors."""
    import pandas as pd

    def work(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "values": [list(complete(p)) for p in batch["prompt"]]})

    kind = dict(prompted.dtypes)[key]
    return prompted.select(key, "prompt").repartition(partitions).mapInPandas(work, f"{key} {kind}, values array<string>")
