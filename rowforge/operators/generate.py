"""Synthetic rows as table work: seeds, term banks, prompts, gates, resume, audit and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.fields import GENERATED_FOR
from rowforge.functions.text import cell, name, scrub, split_labels, strip
from rowforge.operators.greedy import first_independent
from rowforge.session import settle

# Words that are no terms.
STOP_WORDS = (
    "der die das und oder in im mit fuer für von zu den dem des ein eine einen einer eines auf aus bei nach ueber über unter vor durch "
    "als am an ist sind war waren werden wird worden kann koennen können soll sollte muss muessen müssen darf würde man sich auch nicht "
    "nur noch sehr mehr weniger viel viele wenige alle jede jeder jedes kein keine dann wann weil dass damit sowie bzw etc usw also schon "
    "immer wieder gibt haben hat hatte sein seine ihr ihre unser wir ich du er es sie uns euch hier da dort so wie wo warum wieso was wer "
    "welche welcher welches etwas nichts alles jemand zum zur beim vom dieser diese dieses jene jener solche the a an and or of to in for "
    "with without on at is are was were be been being this that these those from into about it its we you they i he she there here very "
    "more most some any no not can could will would should must may your our their http https www com de org url oer ca ggf inkl bzw"
).split()
# Named length corridors, in characters.
CORRIDORS = {"kurz": (120, 300), "standard": (300, 600), "lang": (800, 2000), "volltext": (3000, 6000)}
OPEN_CORRIDOR = (100, 600)
TOKEN = r"[0-9A-Za-zÄÖÜäöüß][0-9A-Za-zÄÖÜäöüß-]{1,}"

#: Chosen rows of a term bank that are sent to every task, some 20 MB at most.
SENT_ROWS = 500_000
#: A token of three characters or more that is no stop word.
CONTENT_WORD = (
    r"(?<![0-9A-Za-zÄÖÜäöüß-])-*+(?!(?iu:" + "|".join(STOP_WORDS) + r")(?![0-9A-Za-zÄÖÜäöüß-]))[0-9A-Za-zÄÖÜäöüß][0-9A-Za-zÄÖÜäöüß-]{2,}"
)


def resolve_corridor(profile: dict | None) -> tuple[str, tuple[int, int]]:
    """(name, (least, most characters)): a named corridor, or else "custom" with the bounds that are given.

    Nothing given means the standard corridor; a missing bound is that of OPEN_CORRIDOR.
    """
    given = {k: v for k, v in (profile or {}).items() if v}
    named = given.get("name", "" if given.keys() & {"min", "max"} else "standard")
    if named in CORRIDORS:
        return named, CORRIDORS[named]
    bounds = tuple(int(given.get(k, default)) for k, default in zip(("min", "max"), OPEN_CORRIDOR, strict=True))
    if bounds[1] <= bounds[0]:
        raise ValueError(f"A corridor from {bounds[0]} to {bounds[1]} characters holds nothing.")
    return "custom", bounds


def term_bank(df: DataFrame, row: str, label: str, keywords: list[str], texts: list[str], separator: str = ",", top_n: int = 60, max_rows: int = 500, share: float = 0.4) -> DataFrame:
    """(label, rank, term): a label's keywords and content words by count, without those of too many labels."""
    listed = [F.filter(F.transform(F.split(cell(c), r"[;,|/]"), strip), lambda x: x != "") for c in keywords]
    words = [F.filter(F.transform(F.regexp_extract_all(cell(c), F.lit(TOKEN), F.lit(0)), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)) for c in texts]
    holds = reduce(lambda a, b: a | b, [*[F.size(x) > 0 for x in listed], *[cell(c).rlike(CONTENT_WORD) for c in texts]])
    # The rows of a label are chosen before any text is split: looking for one content word ends at the first.
    each = df.where(holds).select(name(row).alias("row"), F.explode(split_labels(name(label), separator)).alias("label"))
    n = F.row_number().over(Window.partitionBy("label").orderBy("row"))
    mined = settle(each.withColumn("_n", n).where(F.col("_n") <= max_rows).drop("_n"))
    if mined.count() <= SENT_ROWS:  # then only the chosen texts are split, where they are
        mined = F.broadcast(mined)
        df = df.join(F.broadcast(mined.select(F.col("row").alias("_chosen")).distinct()), name(row) == F.col("_chosen"), "left_semi")
    terms = df.select(name(row).alias("row"), F.concat(*listed, *words).alias("terms"))
    counts = mined.join(terms, "row").select("label", F.explode("terms").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    labels = counts.agg(F.count_distinct("label").alias("labels"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(labels))  # one row
    limit = F.greatest(F.lit(5), F.floor(F.lit(share) * F.col("labels")))
    common = spread.where((F.col("labels") >= 6) & (F.col("df") > limit)).select("term")
    left = counts.join(common, "term", "left_anti").withColumn("low", F.lower("term"))
    once = F.row_number().over(Window.partitionBy("label", "low").orderBy(F.desc("n"), "term"))
    left = left.withColumn("_n", once).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "term"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top_n).select("label", "rank", "term")


def refine_terms(answers: DataFrame, n: int = 30) -> DataFrame:
    """(label, rank, term) of answered terms (label, ord, term): scrubbed, each once whatever its case."""
    clean = answers.withColumn("term", strip(scrub(cell("term")))).where("term <> ''")
    once = F.row_number().over(Window.partitionBy("label", F.lower("term")).orderBy("ord"))
    clean = clean.withColumn("_n", once).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("ord"))
    return clean.withColumn("rank", rank).where(F.col("rank") <= n).select("label", "rank", "term")


def sample_print(title: Column, description: Column) -> Column:
    return F.md5(F.lower(F.concat_ws("\n", title, description)))


def distill(df: DataFrame, row: str, label: str, title: str, description: str, separator: str = ",", per_concept: int = 6, seed: int = 42) -> DataFrame:
    """(label, rank, row): a seeded sample of each label's rows with distinct content."""
    read = df.where((strip(cell(title)) != "") | (strip(cell(description)) != ""))
    read = read.select(name(row).alias("row"), F.explode(split_labels(name(label), separator)).alias("label"), sample_print(strip(cell(title)), strip(cell(description))).alias("print"))
    first = read.groupBy("label", "print").agg(F.min("row").alias("row"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "label", "print"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "row"))
    return first.withColumn("rank", rank).where(F.col("rank") <= per_concept).select("label", "rank", "row")


def seed_answers(answers: DataFrame, n: int) -> DataFrame:
    """The first n answered seeds of each label, scrubbed and marked as bootstrapped."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("ord"))
    few = answers.withColumn("_n", place).where(F.col("_n") <= n)
    return few.select("label", "ord", *[scrub(cell(c)).alias(c) for c in ("title", "description", "keywords")], F.lit("bootstrap").alias("source"))


#: Entries of a prompt's avoid list, and how much of an example it shows.
AVOIDED, EXAMPLE_CHARS = 15, {"title": 80, "description": 220, "keywords": 80}


def prompts(
    planned: DataFrame, seeds: DataFrame, terms: DataFrame | None = None, batch: int = 10, shots: int = 4, per_batch: int = 12, seed: int = 42,
    facets: tuple[str, ...] = ("overview", "exercise", "project"), corridor=(100, 400), guidance: str = "", made: DataFrame | None = None,
) -> DataFrame:
    """(label, call, n, prompt) of planned (label, anchor, needed): seeded shots, a rotating facet and part of the terms.

    `seeds` has label, title and, if known, description and keywords, which examples then show. `made` (label, ord,
    title) are the titles that exist already: the last AVOIDED of a label, by ord, must not be repeated.
    """
    last = F.greatest(F.ceil(F.col("needed") / batch) - 1, F.lit(0)).cast("int")
    calls = planned.where("needed > 0").withColumn("call", F.explode(F.sequence(F.lit(0), last)))
    n = F.least(F.lit(batch).cast("long"), F.col("needed") - F.col("call") * batch)
    fields = [c for c in EXAMPLE_CHARS if c in seeds.columns]
    line = F.concat_ws(" | ", *[F.substring(strip(F.regexp_replace(cell(c), r"(?U)\s+", " ")), 1, EXAMPLE_CHARS[c]) for c in fields])
    told = calls.select("label", "call").join(seeds.select("label", "title", line.alias("line")), "label")
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), "label", F.col("call").cast("string"), "title"))
    told = told.withColumn("_o", pick).withColumn("_n", F.row_number().over(Window.partitionBy("label", "call").orderBy("_o", "title", "line")))
    told = told.where(F.col("_n") <= shots).groupBy("label", "call")
    told = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "; ").alias("shots"))
    out = calls.join(told, ["label", "call"], "left")
    some: Column = F.lit("")
    if terms is not None:
        bank = terms.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("bank"))
        out = out.join(bank, "label", "left")
        start = F.pmod(F.col("call") * per_batch, F.greatest(F.size("bank"), F.lit(1))) + 1
        some = F.coalesce(F.concat(F.lit("\nTerms: "), F.array_join(F.slice(F.col("bank"), start, F.lit(per_batch)), ", ")), F.lit(""))
    avoid: Column = F.lit("")
    if made is not None:
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("ord")))
        lately = made.select("label", "ord", cell("title").alias("title")).withColumn("_n", place).where(F.col("_n") <= AVOIDED)
        lately = lately.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("made"))
        out = out.join(lately, "label", "left")
        titles = F.array_join(F.transform("made", lambda x: x["title"]), "; ")
        avoid = F.concat(F.lit("\nTitles not to be repeated: "), F.coalesce(titles, F.lit("—")))
    facet = F.element_at(F.array(*[F.lit(f) for f in facets]), (F.pmod(F.col("call"), F.lit(len(facets))) + 1).cast("int"))
    text = F.concat(
        F.lit("Write "), n.cast("string"), F.lit(" entries for "), F.col("anchor"), F.lit("; facet: "), facet,
        F.lit(f"; description of {corridor[0]} to {corridor[1]} characters.\nExamples: "), F.coalesce("shots", F.lit("none yet")), some, avoid,
        F.lit(f"\n{guidance}" if guidance else ""),
    )
    return out.select("label", "call", n.alias("n"), text.alias("prompt"))


def cheap_gates(candidates: DataFrame, corridor: tuple[int, int], history: DataFrame | None = None) -> DataFrame:
    """Candidates (label, ord, title, description, keywords) with `verdict`: length, then exact duplicates.

    An item that passes the length gate blocks its content for later ones whatever befalls it afterwards.
    """
    low, high = corridor
    out = candidates.withColumn("_print", sample_print(cell("title"), cell("description")))
    out = out.withColumn("_fits", F.length(cell("description")).between(low, high))
    first = F.row_number().over(Window.partitionBy("_print", "_fits").orderBy("ord"))
    again = first > 1
    if history is not None:
        seen = history.select(sample_print(cell("title"), cell("description")).alias("_print")).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, "_print", "left")
        again = again | F.coalesce("_seen", F.lit(False))
    verdict = F.when(~F.col("_fits"), "discarded_length").when(again, "discarded_duplicate").otherwise("passed")
    texts = [scrub(cell(c)).alias(c) for c in ("title", "description", "keywords")]
    return out.select("label", "ord", *texts, verdict.alias("verdict"))


def quota_gate(gated: DataFrame, needed: DataFrame) -> DataFrame:
    """Passed candidates beyond what their label needs become over_quota; `needed` has label and needed."""
    place = F.row_number().over(Window.partitionBy("label", F.col("verdict") == "passed").orderBy("ord"))
    out = gated.join(needed.select("label", "needed"), "label", "left").withColumn("_n", place)
    over = (F.col("verdict") == "passed") & (F.col("_n") > F.coalesce("needed", F.lit(0)))
    return out.withColumn("verdict", F.when(over, "over_quota").otherwise(F.col("verdict"))).drop("needed", "_n")


def accept(
    candidates: DataFrame, vector: str, needed: DataFrame, corridor: tuple[int, int], reference: DataFrame | None = None,
    history: DataFrame | None = None, leakage: float = 0.9, duplicate: float = 0.95,
) -> DataFrame:
    """All gates in order: quota, length, exact duplicate, leakage, semantic duplicate; `ord` is unique.

    An item that comes when its label has what it needs keeps none from being new: it is over_quota, or what the first
    two gates say of it, and goes no further. Where a label is full depends on the gates and the other way round. So
    everything that vectors and texts say is worked out once, as marks of the rows and links among them. Then, from no
    label being full, rounds over these narrow tables apply the gates to what the last one left open; the earliest
    wrong place comes right in each, so that the places stand after one round more than there are labels at most.
    `reference` and `history` carry vectors in a column of the same name.
    """
    rows, links = _facts(candidates, vector, corridor, reference, history, leakage, duplicate)
    quotas = settle(rows.select("label").distinct().join(needed.select("label", "needed"), "label", "left").fillna(0, ["needed"]))
    full = settle(quotas.where("needed <= 0").select("label", F.lit(-(1 << 62)).alias("upto")))  # a row for each label that is full
    before = None
    while True:
        passed = _passed(rows.join(full, "label", "left").where("upto is null or ord <= upto"), links)
        place = F.row_number().over(Window.partitionBy("label").orderBy("ord"))
        last = passed.select("label", "ord", place.alias("n")).join(quotas.where("needed > 0"), "label")
        last = last.where("n = needed").select("label", F.col("ord").alias("upto"))
        full = settle(last.unionByName(quotas.where("needed <= 0").select("label", F.lit(-(1 << 62)).alias("upto"))))
        state = full.agg(F.count("*"), F.bit_xor(F.xxhash64("label", "upto"))).first()
        if state == before:
            break
        before = state
    placed = rows.join(full, "label", "left").withColumn("live", F.col("upto").isNull() | (F.col("ord") <= F.col("upto")))
    since = placed.where("live and fits").groupBy("print").agg(F.min("ord").alias("since"))
    marked = placed.join(since, "print", "left").join(passed.select("ord", F.lit(True).alias("passed")), "ord", "left")
    verdict = (
        F.when(~F.col("fits"), "discarded_length")
        .when(F.col("known") | (F.col("since") < F.col("ord")), "discarded_duplicate")
        .when(~F.col("live"), "over_quota")
        .when(F.col("leak"), "discarded_leakage")
        .when(F.col("passed"), "passed")
        .otherwise("discarded_semantic_duplicate")
    )
    texts = [scrub(cell(c)).alias(c) for c in ("title", "description", "keywords")]
    return candidates.select("label", "ord", *texts).join(marked.select("ord", verdict.alias("verdict")), "ord").select("label", "ord", "title", "description", "keywords", "verdict")


def _facts(
    candidates: DataFrame, vector: str, corridor: tuple[int, int], reference: DataFrame | None, history: DataFrame | None,
    leakage: float, duplicate: float,
) -> tuple[DataFrame, DataFrame]:
    """What the gates of accept() need to know: (ord, label, print, fits, known, leak, again) of each row, and the links (a, b).

    known says that the history has the content, leak and again that the reference or the history has a vector too near;
    links join rows of the right length that are near to each other. Each comparison of vectors runs once.
    """
    from rowforge.operators import vectors

    content = sample_print(cell("title"), cell("description")).alias("print")
    rows = candidates.select("ord", "label", content, F.length(cell("description")).between(*corridor).alias("fits"))
    coded = candidates.where(F.length(cell("description")).between(*corridor)).select("ord", vector)
    rows = rows.withColumn("known", F.lit(False)) if history is None else rows.join(history.select(content, F.lit(True).alias("known")).distinct(), "print", "left")

    def near(against: DataFrame | None, limit: float, mark: str) -> DataFrame:
        if against is None or vector not in against.columns:
            return rows.withColumn(mark, F.lit(False))
        found = vectors.best_match(coded, "ord", vector, against, vector).where(F.col("similarity") >= limit)
        return rows.join(found.select(F.col("id").alias("ord"), F.lit(True).alias(mark)), "ord", "left")

    rows = near(reference, leakage, "leak")
    rows = near(history, duplicate, "again")
    rows = settle(rows.fillna(False, ["known", "leak", "again"]).withColumn("again", F.col("again") | F.lit(duplicate <= 0)))
    if duplicate <= 0:  # everything is a duplicate then
        return rows, rows.select(F.col("ord").alias("a"), F.col("ord").alias("b")).limit(0)
    return rows, settle(vectors.similar_pairs(coded, "ord", vector, duplicate).select("a", "b"))


def _passed(live: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, label) of the live rows that pass all gates but the quota."""
    first = live.where("fits").groupBy("print").agg(F.min("ord").alias("ord"))
    open_rows = settle(live.where("fits and not known and not leak and not again").join(first, ["print", "ord"], "left_semi").select("ord", "label"))
    for end in "ab":
        links = links.join(open_rows.select(F.col("ord").alias(end)), end, "left_semi")
    kept = first_independent(open_rows.select(F.col("ord").cast("long").alias("id")), links)
    return settle(open_rows.join(kept.select(F.col("id").alias("ord")), "ord", "left_semi"))


def still_needed(planned: DataFrame, samples: DataFrame) -> DataFrame:
    """(label, needed) after what a run has kept; seen contents count in cheap_gates() through the history."""
    kept = samples.where(F.col("status").isin("passed", "approved")).groupBy("label").agg(F.count("*").alias("kept"))
    left = F.greatest(F.lit(0).cast("long"), F.col("needed") - F.coalesce("kept", F.lit(0)))
    return planned.join(kept, "label", "left").select("label", left.alias("needed"))


def audit(samples: DataFrame, planned: DataFrame) -> DataFrame:
    """(label, made, target, mean_sim, max_sim) of exportable samples for each planned label."""
    good = samples.where(F.col("status").isin("passed", "approved")).groupBy("label")
    good = good.agg(F.count("*").alias("made"), F.round(F.avg("sim_max"), 4).alias("mean_sim"), F.round(F.max("sim_max"), 4).alias("max_sim"))
    out = planned.select("label", F.col("needed").alias("target")).join(good, "label", "left")
    return out.select("label", F.coalesce("made", F.lit(0)).cast("long").alias("made"), "target", F.coalesce("mean_sim", F.lit(0.0)).alias("mean_sim"), F.coalesce("max_sim", F.lit(0.0)).alias("max_sim"))


def discards(gated: DataFrame) -> DataFrame:
    """(verdict, count)."""
    return gated.groupBy("verdict").agg(F.count("*").alias("count"))


def training_export(samples: DataFrame, concepts: DataFrame, label_column: str = "label") -> DataFrame:
    """Exportable samples in training columns, the concept with its display name, each marked as generated."""
    good = samples.where(F.col("status").isin("passed", "approved"))
    named = concepts.select(F.col("uri").alias("concept"), F.col("label").alias("_name"))
    out = good.join(named, "concept", "left")
    return out.select(
        "title", "description", "keywords", F.coalesce("_name", "concept").alias(f"{label_column}_DISPLAYNAME"), F.col("concept").alias(label_column),
        F.lit("synthetic").alias("source"), F.col("concept").alias(GENERATED_FOR),
    )
