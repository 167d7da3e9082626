"""Column expressions for text cells: cleaning, values of a cell, numbers, personal data.

A missing cell is the empty string; null is read as missing everywhere. Everything here stays inside the
JVM but for HTML character references and accent folding, which have no built-in function; those two
travel to Python only for the cells that need them.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that define a clean text.
TAG = r"<[A-Za-z/!?][^<>]*>"
MARKDOWN_LINK = r"!?\[([^\[\]]*)\]\([^()]*\)"
MARKDOWN_MARKS = r"[*_`~#>]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: Combining marks of the Latin block.
LATIN_MARKS = re.compile("[\u0300-\u036f]+")
# What counts as personal data, in the order in which it is masked.
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
URL = r"(?U)(?=(?:https?://|www\.)\S)\S*[^\s.,;:!?)]"
PHONE = r"(?U)(?<![\w.])(?:\+\d{1,3}(?:[ /-]?\d){6,}|(?:\(0\d{1,4}\)|0\d{1,4})(?:[ /-]?\d){5,})(?!\w)"
HANDLE = r"(?U)(?<![\w@.])@[A-Za-z0-9_][A-Za-z0-9_.]{1,29}"
#: Kind, pattern, and texts of which a match holds one: most cells hold none and need no look by the pattern.
MASKS = (("email", EMAIL, ("@",)), ("url", URL, ("http", "www.")), ("phone", PHONE, ("0", "+")), ("handle", HANDLE, ("@",)))

# Fixed value: what reads as a number.
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"


def name(column: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{column.replace('`', '``')}`")


def cell(column: Column | str) -> Column:
    """The cell as text; a missing one is empty."""
    column = name(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def as_text_table(df: DataFrame) -> DataFrame:
    """Every column as text, missing cells empty."""
    return df.select(*[cell(c).alias(c) for c in df.columns])


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def number(text: Column) -> Column:
    """The cell as a double; null where it is no number."""
    return F.when(text.rlike(NUMBER), strip(text).try_cast("double"))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    return values.map(lambda text: LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text)), na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references decoded; only cells that may hold one reach Python."""
    return F.coalesce(_unescape(F.when(text.rlike("&[#A-Za-z]"), text)), text)


def clean_markup(text: Column) -> Column:
    """Tags, Markdown and control characters out, white space made even."""
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, MARKDOWN_LINK, "$1")
    text = F.regexp_replace(text, MARKDOWN_MARKS, "")
    text = F.regexp_replace(text, CONTROL, "")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, references: bool = True) -> Column:
    """The text as a classifier reads it; `references=False` where no cell holds a character reference."""
    text = cell(text)
    return clean_markup(unescape(text) if references else text)


def combined_text(columns: list[str], references: bool = True) -> Column:
    """The cells of several columns as one clean text."""
    if not columns:
        raise ValueError("Name at least one text column.")
    return clean_text(F.concat_ws(" ", *[cell(c) for c in columns]), references)


def dedupe_key(text: Column, accents: bool = True) -> Column:
    """Digest under which texts that differ in case or Latin accents are one."""
    low = F.lower(text)
    if accents:
        low = F.coalesce(_without_marks(F.when(low.rlike(r"[^\x00-\x7f]"), low)), low)
    return F.md5(low)


def split_labels(text: Column, separator: str = ",") -> Column:
    """The trimmed, non-empty parts of a cell."""
    if not separator:
        raise ValueError("The separator must not be empty.")
    parts = F.split(cell(text), r"\Q" + separator + r"\E")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def is_container(label: Column) -> Column:
    """A value that names a namespace rather than a concept."""
    return label.endswith("/")


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is named: bound as the element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_hold(text: Column, signs: tuple[str, ...]) -> Column:
    out = text.contains(signs[0])
    for sign in signs[1:]:
        out = out | text.contains(sign)
    return out


def scrub(text: Column) -> Column:
    """Personal data replaced by masks; a URL leaves the punctuation behind it."""
    for kind, pattern, signs in MASKS:
        text = _once(text, lambda t: F.when(_may_hold(t, signs), F.regexp_replace(t, pattern, f"[{kind}]")).otherwise(t))  # noqa: B023
    return text


def pii_counts(text: Column) -> Column:
    """struct(email, url, phone, handle): what scrub() would mask."""
    kinds = [kind for kind, _, _ in MASKS]
    state = F.struct(text.alias("t"))
    for i in range(len(MASKS)):
        state = _once(state, lambda s: _masked_and_counted(s, i))  # noqa: B023
    return _once(state, lambda s: F.struct(*[s[k].alias(k) for k in kinds]))


def _masked_and_counted(state: Column, i: int) -> Column:
    """From the text and the counts of the first i masks those of one mask more."""
    kind, pattern, signs = MASKS[i]
    text = state["t"]
    may = _may_hold(text, signs)
    left = F.when(may, F.regexp_replace(text, pattern, f"[{kind}]")).otherwise(text)
    found = F.when(may, F.regexp_count(text, F.lit(pattern)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.struct(left.alias("t"), *[state[k].alias(k) for k, _, _ in MASKS[:i]], found.alias(kind))


def fold_case(text: Column) -> Column:
    """Caseless form; sharp s counts as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
