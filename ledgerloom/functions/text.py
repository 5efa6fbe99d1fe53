"""Text, number and date functions as column expressions.

Everything but ``similarity`` is made of built-in functions and stays in generated code.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters with marks and their base letters, then the marks alone, which translate() deletes."""
    marked, base, marks = [], [], []
    for code in range(0xC0, 0x2C00):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if not plain:
            marks.append(char)
        elif plain != char and len(plain) == 1:
            marked.append(char)
            base.append(plain)
    return "".join(marked + marks), "".join(base)


def strip_accents(c: Column) -> Column:
    """Text without combining marks; null gives an empty text."""
    return F.translate(F.coalesce(c, F.lit("")), *_accents())


def normalize_text(c: Column) -> Column:
    """Upper case, without accents, runs of anything but A-Z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]+", " "))


def normalize_column(name: str) -> str:
    """Header as lower-case words joined by underscores."""
    plain = "".join(x for x in unicodedata.normalize("NFD", name) if unicodedata.category(x) != "Mn").upper()
    return "_".join("".join(x if "A" <= x <= "Z" or "0" <= x <= "9" else " " for x in plain).lower().split())


def normalize_value(text: str) -> str:
    """normalize_text() of a literal."""
    return normalize_column(text).replace("_", " ").upper()


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def to_float(c: Column) -> Column:
    """Number in a text with a comma or a dot as decimal mark; 0.0 if there is none."""
    x = F.replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(" "), F.lit(""))
    both = x.contains(",") & x.contains(".")
    x = F.when(both, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit(".")))
    return F.when(x.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double")).otherwise(F.lit(0.0))


def parse_date(c: Column) -> Column:
    """Date at the head of the first ten characters, as d/m/Y, Y-m-d or d-m-Y, or else of a text in another usual form, day first; null otherwise."""
    whole = F.trim(c.cast("string"))
    head = F.split_part(F.substring(whole, 1, 10), F.lit(" "), F.lit(1))
    at = lambda x, p: F.to_date(F.try_to_timestamp(x, F.lit(p)))
    # a time of day behind the date says nothing; month names are read in title case, separators are one kind
    date = F.regexp_replace(whole, r"[T ]+[0-9]{1,2}:[0-9]{2}.*$", "")
    plain = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(date, r"[/.,\-\s]+", " "), r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")))
    forms = ("d M yyyy", "yyyy M d", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyy MMM d", "yyyyMMdd", "M d yyyy", "d M yy", "d MMM yy", "M d yy", "MMM yyyy", "MMMM yyyy", "M yyyy", "yyyy M")
    return F.coalesce(*(at(head, p) for p in ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")), *(at(plain, p) for p in forms))


def compound_document(*parts: Column) -> Column:
    """Parts that say something, joined by dashes."""
    cleaned = []
    for p in parts:
        t = F.trim(p.cast("string"))
        cleaned.append(F.when(~F.lower(t).isin("", "none", "nan", "-"), t))
    return F.concat_ws("-", *cleaned)


def clean_description(c: Column) -> Column:
    """White space collapsed; a name that is written twice in a row is written once."""
    x = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    half = F.floor(F.length(x) / 2).cast("int")
    first, second = F.trim(F.substr(x, F.lit(1), half)), F.trim(F.substr(x, half + 1))
    return F.when((half > 8) & (first == second), first).otherwise(x)


def singular(token: Column) -> Column:
    return (
        F.when((F.length(token) > 4) & token.endswith("ES"), F.substr(token, F.lit(1), F.length(token) - 2))
        .when((F.length(token) > 3) & token.endswith("S"), F.substr(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def stable_int(*parts: Column) -> Column:
    """Sum of place times code point over the parts joined by a bar."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x, i: (i + 1).cast("long") * F.ascii(x))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x)


def format_g(c: Column) -> Column:
    """Shortest form of a number: no point for whole numbers."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), F.trim), lambda x: x != "")


def parse_confidence(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "map<string,double>"), F.create_map().cast("map<string,double>"))


def attr_node_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.replace(normalize_text(value), F.lit(" "), F.lit("_")))


def package_label(units: Column) -> Column:
    return (
        F.when(units >= 1000, F.format_string("%.1f millares", units / 1000.0))
        .when(units >= 100, F.concat(F.floor(units / 100).cast("string"), F.lit(" cientos")))
        .otherwise(F.concat(units.cast("string"), F.lit(" unidades")))
    )


def readable_supplier_name(c: Column) -> Column:
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    fixed = F.transform(words, lambda w: F.when(F.upper(w).isin("SAC", "EIRL", "SRL", "SA", "S.A."), F.replace(F.upper(w), F.lit("S.A."), F.lit("SA"))).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.array_join(fixed, " ")


def _indel(a: str, b: str) -> int:
    """Length of both texts less twice their longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def token_set_ratio(left: str, right: str) -> float:
    """0 to 1: best match of the common words alone, or with the words that only one side has."""
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    common, only_a, only_b = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if common and (not only_a or not only_b):
        return 1.0
    apart, joint = _indel(only_a, only_b), len(common) + bool(common)
    best = 1 - apart / (2 * joint + len(only_a) + len(only_b))
    if common:
        for rest in (only_a, only_b):
            best = max(best, 1 - (1 + len(rest)) / (2 * len(common) + 1 + len(rest)))
    return best


def may_reach(text: str, c: Column, least: float) -> Column:
    """Whether a normalised column can have a similarity of ``least`` with a normalised text: it has a word of it, or enough of its letters.

    Without a common word the similarity is twice the longest common subsequence by the length of both, and that subsequence has no letter more often than
    either text. Built-in functions only: what fails needs no comparing in Python.
    """
    words = text.split()
    if not words:
        return F.lit(False)
    shared = F.arrays_overlap(F.split(c, " "), F.array(*(F.lit(w) for w in words)))
    joined = " ".join(sorted(set(words)))
    letters = sum((F.least(F.lit(joined.count(x)), F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) for x in sorted(set(joined))), F.lit(0))
    own = F.length(F.array_join(F.array_distinct(F.split(c, " ")), " "))
    return F.coalesce(shared | (2.0 * letters >= least * (len(joined) + own) - 1e-9), F.lit(False))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """token_set_ratio() of two normalised texts, in Arrow batches; equal pairs are scored once."""
    pairs = pd.DataFrame({"l": left.fillna(""), "r": right.fillna("")})
    once = pairs.drop_duplicates()
    scores = {(x, y): token_set_ratio(x, y) for x, y in once.itertuples(index=False)}
    return pd.Series([scores[x] for x in pairs.itertuples(index=False, name=None)], dtype="float64")
