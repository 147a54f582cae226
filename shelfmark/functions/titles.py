"""Title folding and similarity."""

from __future__ import annotations

import difflib
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _ascii_forms() -> tuple[str, str, str]:
    """Characters whose compatibility form holds ASCII: those with one letter as two aligned
    strings, those with more as the text of a map (character, control 1, form; control 2)."""
    sources, targets, longer = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            sources.append(char)
            targets.append(plain)
        elif plain:
            longer.append(f"{char}\x01{plain}")
    return "".join(sources), "".join(targets), "\x02".join(longer)


def _to_ascii(title: Column) -> Column:
    """Strip accents and drop what has no ASCII form; only non-ASCII titles pay for it."""
    sources, targets, longer = _ascii_forms()
    # One literal that Spark folds into a map when it optimises the plan.
    table = F.str_to_map(F.lit(longer), F.lit("\x02"), F.lit("\x01"))
    one = F.translate(title, sources, targets)
    spelled = F.array_join(
        F.transform(F.split(one, ""), lambda c: F.when(c <= F.lit("\x7f"), c).otherwise(
            F.coalesce(F.try_element_at(table, c), F.lit("")))),
        "",
    )
    plain = F.when(one.rlike(r"[^\x00-\x7F]"), spelled).otherwise(one)
    return F.when(title.rlike(r"[^\x00-\x7F]"), plain).otherwise(title)


def fold_title(title: Column) -> Column:
    """Comparison form: accents folded, lower case, punctuation to blanks, one article off."""
    text = F.lower(_to_ascii(title))
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    return F.regexp_replace(text, "^(?:the|a|an) ", "")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratios of a batch, null where a side is empty or both are equal. The index of a second title is built once
    for all first titles of the batch that meet it."""
    out = [None] * len(a)
    matcher, held = difflib.SequenceMatcher(None), None
    for i in b.reset_index(drop=True).sort_values(kind="stable").index:
        x, y = a.iat[i], b.iat[i]
        if not x or not y or x == y:
            continue
        if y != held:
            matcher.set_seq2(y)
            held = y
        matcher.set_seq1(x)
        out[i] = matcher.ratio()
    return pd.Series(out, dtype="float64")


def with_similarities(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each ``out: (a, b)``, the similarity of two title columns: 0 when a side is
    missing or folds to nothing, 1 when the folded titles are equal, else their
    Ratcliff-Obershelp ratio (not symmetric: ``a`` is the local title).

    The ratio has no built-in. All column pairs are computed together, once per distinct set of their folded titles,
    and joined back in one join. Rows that need no ratio (a side missing, or equal titles, which one popular title
    can make most of all rows) take a join key of their own, so they spread evenly.
    """
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    sides = {out: (f"__{out}_a", f"__{out}_b") for out in wanted}
    names = [n for pair in sides.values() for n in pair]
    text = lambda c: F.coalesce(fold_title(F.col(c)), F.lit(""))
    folded = df.withColumns({n: text(c) for out in wanted for n, c in zip(sides[out], wanted[out])})
    unequal = F.lit(False)
    for a, b in sides.values():
        unequal = unequal | ((F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b)))
    ratios = folded.where(unequal).select(*names).distinct().withColumns(
        {f"__{out}_r": _ratio(F.col(a), F.col(b)) for out, (a, b) in sides.items()})
    ratios = ratios.withColumn("__ratio_key", F.xxhash64(*names))
    result = folded.withColumn("__ratio_key", F.when(unequal, F.xxhash64(*names)).otherwise(F.xxhash64(*hashable)))
    result = result.join(ratios, ["__ratio_key", *names], "left")
    result = result.withColumns({
        out: F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(F.col(a) == F.col(b), 1.0).otherwise(F.col(f"__{out}_r"))
        for out, (a, b) in sides.items()})
    return result.drop("__ratio_key", *names, *[f"__{out}_r" for out in wanted])


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``with_similarities`` of one pair of columns."""
    return with_similarities(df, {out: (a, b)})
