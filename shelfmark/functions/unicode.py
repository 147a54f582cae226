"""Canonical composition (NFC) in built-in expressions.

A text needs work only where it holds a character that composition may touch: a mark, the second half of a composed
character, or one whose canonical form is another. Those texts are decomposed, their marks put in canonical order,
and composed again, character by character in one fold. The tables follow from the interpreter's Unicode data.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Hangul blocks, whose composition is arithmetic.
_LEADS, _VOWELS, _TAILS, _SYLLABLES = 0x1100, 0x1161, 0x11A7, 0xAC00
_LEAD_COUNT, _VOWEL_COUNT, _TAIL_COUNT = 19, 21, 28
_SYLLABLE_COUNT = _LEAD_COUNT * _VOWEL_COUNT * _TAIL_COUNT


def _is_syllable(code: int) -> bool:
    return _SYLLABLES <= code < _SYLLABLES + _SYLLABLE_COUNT


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str]:
    """A character class of what may change, and three maps as text (entries end with control 2, sides are parted by
    control 1): full decompositions, composed pairs, combining classes."""
    parts, pairs, classes, touched = [], [], [], set()
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or _is_syllable(code):
            continue
        order = unicodedata.combining(char)
        if order:
            classes.append(f"{char}\x01{order}")
            touched.add(code)
        apart = unicodedata.normalize("NFD", char)
        if apart == char:
            continue
        parts.append(f"{char}\x01{apart}")
        if unicodedata.normalize("NFC", char) != char:
            touched.add(code)
            continue
        two = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(char).split())
        pairs.append(f"{two}\x01{char}")
        touched.add(ord(two[-1]))
    touched.update(range(_VOWELS, _VOWELS + _VOWEL_COUNT), range(_TAILS + 1, _TAILS + _TAIL_COUNT))
    ranges, codes = [], sorted(touched)
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    members = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    return f"[{members}]", *("\x02".join(x) for x in (parts, pairs, classes))


def _map(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _joined(first: Column, second: Column, pairs: Column) -> Column:
    """The composed character of two, or null."""
    a, b = F.ascii(first), F.ascii(second)
    lead, vowel, tail = a - _LEADS, b - _VOWELS, b - _TAILS
    open_ = (a >= _SYLLABLES) & (a < _SYLLABLES + _SYLLABLE_COUNT) & ((a - _SYLLABLES) % _TAIL_COUNT == 0)
    return (
        F.when((lead >= 0) & (lead < _LEAD_COUNT) & (vowel >= 0) & (vowel < _VOWEL_COUNT),
               _char(_SYLLABLES + (lead * _VOWEL_COUNT + vowel) * _TAIL_COUNT))
        .when(open_ & (tail > 0) & (tail < _TAIL_COUNT), _char(a + tail))
        .otherwise(F.try_element_at(pairs, F.concat(first, second))))


def composed(raw: Column) -> Column:
    """NFC form of a text; null stays null."""
    touched, parts, pairs, classes = _tables()
    parts, pairs, classes = _map(parts), _map(pairs), _map(classes)
    apart = F.flatten(F.transform(F.split(raw, ""), lambda c: F.when(
        c <= F.lit("\x7f"), F.array(c)).otherwise(F.split(F.coalesce(F.try_element_at(parts, c), c), ""))))
    kinds = F.transform(apart, lambda c: F.struct(
        c.alias("char"), F.when(c <= F.lit("\x7f"), 0).otherwise(
            F.coalesce(F.try_element_at(classes, c).cast("int"), F.lit(0))).alias("order")))
    # Marks are sorted by class, in place, behind the character they follow; each fold step knows its run's number.
    none = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<run:int,order:int,at:int,char:string>>").alias("out"))
    numbered = F.aggregate(kinds, none, lambda s, k: F.struct(
        (s["run"] + F.when(k["order"] == 0, 1).otherwise(0)).alias("run"),
        F.concat(s["out"], F.array(F.struct(
            (s["run"] + F.when(k["order"] == 0, 1).otherwise(0)).alias("run"), k["order"].alias("order"),
            F.size(s["out"]).alias("at"), k["char"].alias("char")))).alias("out")))["out"]
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(s: Column, k: Column) -> Column:
        """A character joins the one its marks hang on, unless a mark of its own class or higher stands between."""
        free = (s["base"] != "") & ((s["marks"] == "") | (s["last"] < k["order"]))
        both = F.when(free, _joined(s["base"], k["char"], pairs))
        mark = k["order"] > 0
        return (
            F.when(both.isNotNull(), F.struct(s["done"].alias("done"), both.alias("base"), s["marks"].alias("marks"), s["last"].alias("last")))
            .when(mark, F.struct(s["done"].alias("done"), s["base"].alias("base"), F.concat(s["marks"], k["char"]).alias("marks"), k["order"].alias("last")))
            .otherwise(F.struct(F.concat(s["done"], s["base"], s["marks"]).alias("done"), k["char"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))))

    whole = F.aggregate(F.array_sort(numbered), start, step, lambda s: F.concat(s["done"], s["base"], s["marks"]))
    # Nothing below 0x80 is touched: texts of as many bytes as characters pass without a look at the long class.
    return F.when((F.octet_length(raw) > F.char_length(raw)) & raw.rlike(touched), whole).otherwise(raw)
