"""Label operators on the edge table (row, label): filters, reports, the training preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.fields import NAME_CHARS, TextField, label_name, one_line
from rowforge.functions.text import cell, combined_text, dedupe_key, is_container, name, pii_counts, scrub, split_labels
from rowforge.operators.greedy import learnable, quota_items
from rowforge.operators.ranks import percentiles
from rowforge.operators.result import OpResult
from rowforge.session import settle


def auto_min_samples(rows: Column) -> Column:
    """Recommended rows of a label: 2, 5, 20 or 35, from 1,000, 10,000 and 50,000 rows on."""
    return F.when(rows < 1_000, 2).when(rows < 10_000, 5).when(rows < 50_000, 20).otherwise(35)


def edges(df: DataFrame, row: str, label: str, separator: str = ",", distinct: bool = True) -> DataFrame:
    """(row, label) of every label of every row."""
    parts = split_labels(name(label), separator)
    return df.select(name(row).alias("row"), F.explode(F.array_distinct(parts) if distinct else parts).alias("label"))


def drop_no_label(df: DataFrame, label: str, separator: str = ",") -> DataFrame:
    """Rows with at least one label."""
    return df.where(F.size(split_labels(name(label), separator)) > 0)


def length_filter(df: DataFrame, text: list[str], low: int = 0, high: int = 10**9, references: bool = True) -> DataFrame:
    """Rows whose clean text has `low` to `high` characters."""
    return df.where(F.length(combined_text(text, references)).between(low, high))


def label_filter(df: DataFrame, label: str, substring: str, separator: str = ",") -> OpResult:
    """Keep the labels that contain `substring` and the rows that have one; names follow only where they pair."""
    if not substring:
        raise ValueError("Name the text that a label must contain.")
    shown = f"{label}_DISPLAYNAME"
    found = df.withColumn("_all", split_labels(name(label), separator))
    found = found.withColumn("_kept", F.filter("_all", lambda x: x.contains(substring)))
    stats = found.agg(
        F.count("*").alias("before"),
        F.count_if(F.size("_kept") > 0).alias("after"),
        F.count_if(F.size("_kept") == 0).alias("removed"),
        F.count_if((F.size("_kept") > 0) & (F.size("_kept") < F.size("_all"))).alias("changed"),
    )
    new = {label: F.array_join("_kept", separator)}
    if shown in df.columns:
        names = split_labels(name(shown), separator)
        pairs = F.filter(F.arrays_zip(F.col("_all").alias("l"), names.alias("n")), lambda p: p["l"].contains(substring))
        paired = F.when(F.size(names) == F.size("_all"), F.array_join(F.transform(pairs, lambda p: p["n"]), separator)).otherwise("")
        new[shown] = F.when(F.size("_kept") == F.size("_all"), cell(shown)).otherwise(paired)
    out = found.where(F.size("_kept") > 0).select(*[new.get(c, name(c)).alias(c) for c in df.columns])
    return OpResult(out, stats)


def cap_per_label(df: DataFrame, row: str, label: str, cap: int, separator: str = ",") -> DataFrame:
    """In row order, keep a row while one of its labels has under `cap` kept rows; unlabelled rows go."""
    if cap < 1:
        raise ValueError("The cap must be 1 or more.")
    each = edges(df, row, label, separator, distinct=False).groupBy("row", "label").agg(F.count("*").alias("weight"))
    each = each.select(F.col("row").alias("item"), F.col("row").alias("ord"), "label", "weight", F.lit(cap).alias("quota"))
    taken = quota_items(each, cap)
    return df.join(taken.withColumnRenamed("item", "_taken"), name(row) == F.col("_taken"), "left_semi")


def first_of_key(df: DataFrame, row: str, key: Column) -> DataFrame:
    """(row, first): the smallest row of the same key for every row that has a key.

    Keys are worked out once and kept with their rows only; both sides of the join are tables, which Spark can divide at
    a key that very many rows share.
    """
    keyed = settle(df.select(name(row), key.alias("_key")))
    first = settle(keyed.groupBy("_key").agg(F.min(name(row)).alias("first")))
    return keyed.join(first, "_key").select(name(row), "first")


def dedupe_exact(df: DataFrame, row: str, text: list[str], references: bool = True) -> DataFrame:
    """The first row of each clean text, the empty one included."""
    body = combined_text(text, references)
    digest = F.struct(F.md5(body).alias("m"), F.xxhash64(body).alias("x"))
    first = df.select(name(row).alias("_row"), digest.alias("_d")).groupBy("_d").agg(F.min("_row").alias("_row"))
    return df.join(first, name(row) == F.col("_row"), "left_semi")


def balance_report(df: DataFrame, row: str, label: str, separator: str = ",") -> DataFrame:
    """(label, support, recommended_min_samples, below): support counts a label once per row."""
    labels = F.array_distinct(split_labels(name(label), separator))
    # One pass for both: every row also counts under null, which is no label.
    each = df.select(F.explode(F.concat(labels, F.array(F.lit(None).cast("string")))).alias("label"))
    counts = settle(each.groupBy("label").agg(F.count("*").alias("support")))
    total = counts.where("label is null").agg(F.coalesce(F.sum("support"), F.lit(0)).alias("rows"))
    out = counts.where("label is not null").crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("recommended_min_samples", auto_min_samples(F.col("rows")))
    return out.select("label", "support", "recommended_min_samples", (F.col("support") < F.col("recommended_min_samples")).alias("below"))


def analyze(df: DataFrame, row: str, text: list[str], label: str, separator: str = ",", references: bool = True, pii: bool = False) -> DataFrame:
    """One row on the whole table: labels, empty and repeated texts, lengths; with `pii` also pii_report()'s columns."""
    read = df.select(
        combined_text(text, references).alias("t"),
        F.array_distinct(split_labels(name(label), separator)).alias("l"),
    )
    by_text = read.groupBy(F.md5("t").alias("m"), F.length("t").alias("n")).agg(F.count("*").alias("k"))
    texts = by_text.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("k"))), F.lit(0)).alias("empty_text_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("k") - 1)), F.lit(0)).alias("exact_duplicate_rows"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_length"),
        F.coalesce(F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 1), F.lit(0.0)).alias("mean_length"),
    )
    labels = read.select(F.explode("l").alias("label")).groupBy("label").count().agg(
        F.count("*").alias("unique_labels"), F.count_if(F.col("count") < 10).alias("rare_labels_under_10")
    )
    bare = read.agg(F.count_if(F.size("l") == 0).alias("rows_without_label"))
    out = texts.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(bare))  # one row each
    return out.crossJoin(F.broadcast(pii_report(df, text, references))) if pii else out


def pii_report(df: DataFrame, text: list[str], references: bool = True) -> DataFrame:
    """rows_scanned, rows_affected and the count of each category."""
    found = df.select(pii_counts(combined_text(text, references)).alias("p"))
    kinds = ("email", "url", "phone", "handle")
    hit = sum((F.col(f"p.{k}") for k in kinds), F.lit(0)) > 0
    return found.agg(F.count("*").alias("rows_scanned"), F.count_if(hit).alias("rows_affected"), *[F.coalesce(F.sum(f"p.{k}"), F.lit(0)).alias(k) for k in kinds])


def pii_filter(df: DataFrame, text: list[str], mode: str = "mask") -> OpResult:
    """Mask personal data in the text columns, or drop the rows that hold any."""
    if mode not in ("mask", "drop"):
        raise ValueError("The mode is 'mask' or 'drop'.")
    hit = F.lit(False)
    for c in text:
        hit = hit | (scrub(cell(c)) != cell(c))
    stats = df.agg(F.count("*").alias("before"), F.count_if(hit).alias("rows_with_pii"))
    if mode == "drop":
        return OpResult(df.where(~hit), stats)
    return OpResult(df.withColumns({c: scrub(cell(c)) for c in text}), stats)


def markup_filter(df: DataFrame, text: list[str], references: bool = True) -> OpResult:
    """Clean the text columns in place; stats count the rows that changed."""
    from rowforge.functions.text import clean_text

    changed = F.lit(False)
    for c in text:
        changed = changed | (clean_text(name(c), references) != cell(c))
    stats = df.agg(F.count("*").alias("before"), F.count_if(changed).alias("changed"))
    return OpResult(df.withColumns({c: clean_text(name(c), references) for c in text}), stats)


def preflight_rows(
    df: DataFrame, row: str, text: list[str], label: str, separator: str = ",", substring: str | None = None,
    min_length: int = 5, drop_duplicates: bool = True, references: bool = True, accents: bool = True,
) -> DataFrame:
    """(row, labels, fate) of every row: kept, or dropped for no_label, too_short or duplicate, in that order."""
    labels = F.filter(F.array_distinct(split_labels(name(label), separator)), lambda x: ~is_container(x))
    if substring:
        labels = F.filter(labels, lambda x: x.contains(substring))
    # The clean text is a column of its own, which Spark works out once; behind it only a digest is kept.
    read = df.select(name(row).alias("row"), labels.alias("labels"), combined_text(text, references).alias("body"))
    early = F.when(F.size("labels") == 0, "no_label").when(F.length("body") < min_length, "too_short")
    if not drop_duplicates:
        return read.select("row", "labels", F.coalesce(early, F.lit("kept")).alias("fate"))
    read = settle(read.select("row", "labels", early.alias("early"), dedupe_key(F.col("body"), accents).alias("key")))
    first = read.where("early is null").groupBy("key").agg(F.min("row").alias("row")).select("row", F.lit("kept").alias("kept"))
    fate = F.coalesce("early", "kept", F.lit("duplicate"))
    return read.join(first, "row", "left").select("row", "labels", fate.alias("fate"))


def preflight(rows: DataFrame, min_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, one row for each label) of the effective training set; `rows` as preflight_rows() gives."""
    rows = settle(rows)
    fates = {r["fate"]: r["count"] for r in rows.groupBy("fate").count().collect()}  # four rows
    kept = fates.get("kept", 0)
    spark = rows.sparkSession
    ladder = 2 if kept < 1_000 else 5 if kept < 10_000 else 20 if kept < 50_000 else 35
    least = max(1, min_samples) if min_samples is not None else ladder
    each = rows.where("fate = 'kept'").select(F.col("row").alias("item"), F.explode("labels").alias("label"))
    good, effective = learnable(each, kept, least)
    counts = each.groupBy("label").agg(F.count("*").alias("support"))
    good = good.withColumn("learnable", F.lit(True))
    state = F.when(F.col("learnable"), "learnable").when(F.col("support") < least, "below_min").otherwise("ubiquitous")
    labels = counts.join(good, "label", "left").select("label", "support", state.alias("state"))
    total = sum(fates.values())
    first = [(total, kept, *[fates.get(f, 0) for f in ("too_short", "no_label", "duplicate")], least, effective)]
    schema = "raw_rows long, kept_after_cleaning long, too_short long, no_label long, duplicate long, min_samples int, effective_rows long"
    return spark.createDataFrame(first, schema), labels


def display_names(df: DataFrame, row: str, label: str, shown: str | None = None, separator: str = ",") -> DataFrame:
    """(label, name): the name that most rows give a label; paired rows before whole cells, ties to the first row."""
    shown = shown or f"{label}_DISPLAYNAME"
    labels, names = split_labels(name(label), separator), split_labels(name(shown), separator)
    read = df.select(name(row).alias("row"), labels.alias("l"), names.alias("n"), cell(shown).alias("whole"))
    paired = read.where(F.size("l") == F.size("n")).select("row", F.explode(F.arrays_zip("l", "n")).alias("p"))
    paired = paired.select("row", F.col("p.l").alias("label"), one_line(F.col("p.n"), NAME_CHARS).alias("name"), F.lit(1).alias("pair"))
    single = read.where((F.size("l") == 1) & (F.size("n") != 1))
    single = single.select("row", F.col("l")[0].alias("label"), one_line(F.col("whole"), NAME_CHARS).alias("name"), F.lit(0).alias("pair"))
    votes = paired.unionByName(single).where("name <> ''").groupBy("label", "pair", "name")
    votes = votes.agg(F.count("*").alias("n"), F.min("row").alias("first"))
    return votes.groupBy("label").agg(F.max_by("name", F.struct("pair", "n", (-F.col("first")).alias("f"))).alias("name"))


def contrast_labels(each: DataFrame, names: DataFrame | None = None, cap: int = 30, with_rest: bool = False) -> DataFrame:
    """(label, rank, other): the other labels by shared rows, support and name, each name once, `cap` at most.

    `with_rest` adds `more`, the number of names beyond the list.

    `each` has row and label, distinct. Rows with many labels make many pairs: a row's labels are bounded. Of the labels
    that share rows with one no more than `cap` names are held together.
    """
    support = each.groupBy("label").agg(F.count("*").alias("support"))
    a, b = each.withColumnRenamed("label", "other"), each
    shared = b.join(a, "row").where("label <> other").groupBy("label", "other").agg(F.count("*").alias("shared"))
    if names is None:
        shown = support.select("label", "support", label_name(F.col("label")).alias("shown"))
    else:
        shown = support.join(names, "label", "left").select("label", "support", label_name(F.col("label"), F.col("name")).alias("shown"))
    named = shared.join(shown.withColumnsRenamed({"label": "other", "shown": "other_name"}), "other").join(shown.select("label", "shown"), "label")
    order = [F.desc("shared"), F.desc("support"), F.asc("other")]
    once = F.row_number().over(Window.partitionBy("label", "other_name").orderBy(*order))
    named = named.where((F.col("other_name") != F.col("shown")) & (F.col("other_name") != "")).withColumn("_n", once).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    first = named.withColumn("rank", rank).where(F.col("rank") <= cap).groupBy("label")
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_name"))), lambda x: x["other_name"]).alias("names"))
    # Behind those that share rows come all others by support. A list of fewer than cap names leaves out at most these
    # and its own from that order, so that its first 2 * cap names are enough for every label.
    leading = shown.where("shown <> ''").groupBy("shown").agg(F.max("support").alias("s"), F.min_by("label", F.struct(-F.col("support"), F.col("label"))).alias("l"))
    leading = [r["shown"] for r in leading.orderBy(F.desc("s"), "l").limit(2 * cap).collect()]
    lists = shown.join(first, "label", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    others = F.filter(F.array(*[F.lit(n) for n in leading]).cast("array<string>"), lambda n: (n != F.col("shown")) & ~F.array_contains("names", n))
    whole = F.concat("names", F.slice(others, F.lit(1), cap - F.size("names")))
    listed = lists.select("label", F.posexplode(whole).alias("rank", "other")).withColumn("rank", F.col("rank") + 1)
    if not with_rest:
        return listed
    named = shown.where("shown <> ''").agg(F.count_distinct("shown").alias("names"))
    rest = shown.crossJoin(F.broadcast(named))  # one row
    rest = rest.select("label", F.greatest(F.lit(0), F.col("names") - (F.col("shown") != "").cast("int") - cap).cast("long").alias("more"))
    return listed.join(rest, "label")


MAX_STATED, MAX_VALUE, MIN_FILLED = 1500, 2000, 5


def _rounded(value: Column, step: int) -> Column:
    return F.greatest(F.lit(step), F.floor(value / step + 0.5) * step).cast("long")


def field_shapes(df: DataFrame, field: TextField, label: Column | None = None) -> DataFrame:
    """(label, chars_low, chars_high, values_low, values_high): the middle half of a field's lengths.

    Labels with under MIN_FILLED filled cells take the whole table's shape; without `label` one row.
    """
    text = field.normal()
    read = settle(df.select((F.lit("") if label is None else label).alias("label"), F.length(text).alias("n"), F.size(field.values()).alias("k")))

    def halves_of(rows: DataFrame, by: list[str], column: str) -> DataFrame:
        counted = rows.where("n > 0").groupBy(*by, F.col(column).alias("x")).agg(F.count("*").alias("n"))
        found = percentiles(counted, by, {"low": 0.25, "high": 0.75})
        return found.select(*by, F.array("low", "high").alias("c" if column == "n" else "v"))

    def shape(rows: DataFrame, *by: str) -> DataFrame:
        halves = rows.groupBy(*by).agg(F.count_if(F.col("n") > 0).alias("filled"))
        for column in ("n", "k"):
            halves = halves.join(halves_of(rows, list(by), column), list(by), "left")
        low = _rounded(F.col("c")[0], 10)
        high = F.greatest(low, _rounded(F.col("c")[1], 10))
        cut = F.lit(MAX_STATED).cast("long")
        chars_low = F.when(low < MAX_STATED, low).when(low < MAX_VALUE, cut)
        chars_high = F.when(low < MAX_STATED, F.least(high, cut)).when(low < MAX_VALUE, cut)
        few = F.greatest(_rounded(F.col("v")[0], 1), F.lit(field.min_values).cast("long"))
        most = F.greatest(_rounded(F.col("v")[1], 1), _rounded(F.col("v")[0], 1), few)
        listed = F.lit(field.separator is not None) & (high <= MAX_STATED)
        return halves.select(*by, "filled", chars_low.alias("chars_low"), chars_high.alias("chars_high"), F.when(listed, few).alias("values_low"), F.when(listed, most).alias("values_high"))

    columns = ["chars_low", "chars_high", "values_low", "values_high"]
    whole = shape(read.withColumn("all", F.lit(0)), "all")
    if whole.isEmpty():  # the shape of a table without rows
        whole = df.sparkSession.createDataFrame([(0, None, None, None, None)], f"filled int, {', '.join(f'{c} long' for c in columns)}")
    whole = whole.select(*[F.when(F.col("filled") >= MIN_FILLED, F.col(c)).alias(f"all_{c}") for c in columns])
    if label is None:
        return whole.select(F.lit("").alias("label"), *[F.col(f"all_{c}").alias(c) for c in columns])
    own = shape(read, "label").crossJoin(F.broadcast(whole))  # one row
    return own.select("label", *[F.when(F.col("filled") >= MIN_FILLED, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in columns])
