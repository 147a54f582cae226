"""Removal of passages that repeat, by hashing of units.

A text is cut at line ends and after sentences; a sentence of fewer than LONG words goes with the next of its line,
so the cuts depend on nothing but what stands there and a passage is cut alike wherever it stands. Units are
normalised (lower case, white space evened out) and hashed to 96 bits. Of the texts that hold a unit the one with
the least rank (its id) keeps its first occurrence; every other occurrence is a repeat. A line of nothing but repeats
is removed whatever its length, and so is a paragraph or text of such lines. Sentences inside a line with other text
are removed in runs of repeats next to each other that come to LEAST words, so a short phrase that turns up by chance
stays there.

Only digests, ids and places are shuffled and grouped; a unit that every text holds is combined before the shuffle,
and the join that brings its place back can be split. A text travels once, with the places to leave out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

LONG = 5
LEAST = 10
_LAST = 2**63 - 1
_SENTENCE = re.compile(r"[^\n.!?]*+(?:[.!?]++(?!\s|\Z)[^\n.!?]*+)*+(?:[.!?]++|\n|\Z)")


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each unit, without the white space around it."""
    out, start, words = [], -1, []
    end = 0
    for m in _SENTENCE.finditer(text):
        own = m.group().split()
        if own:
            if start < 0:
                start = m.start() + len(m.group()) - len(m.group().lstrip())
            words += own
            end = m.start() + len(m.group().rstrip())
        if words and (len(own) >= LONG or m.group().endswith("\n") or text[m.end():m.end() + 1] == "\n"):
            out.append((start, end, words))
            start, words = -1, []
    if words:
        out.append((start, end, words))
    return out


def digest(words: list[str]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(" ".join(words).lower().encode("utf-8", "surrogatepass"))
    return (h >> 64) - 2**63, (h & 0xFFFFFFFF) - 2**31


_UNITS = "hi long, lo int, rank long, version long, place int"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        rows = []
        for rank, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            seen, version = set(), zlib.crc32(text.encode("utf-8", "surrogatepass"))
            for place, (_, _, words) in enumerate(units(text)):
                d = digest(words)
                if d not in seen:
                    seen.add(d)
                    rows.append((*d, rank, version, place))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["hi", "lo", "rank", "version", "place"])


def spans(text: str, repeats: set[int], least: int) -> list[tuple[int, int]]:
    """What to leave out: lines of repeated units only, and runs of repeated units of at least that many words.
    `repeats`: the places of units that another text holds first; later occurrences inside the text are found here."""
    found, again, seen, again_at = units(text), [], set(), {}
    for place, (_, _, words) in enumerate(found):
        d = digest(words)
        again_at.setdefault(d, place in repeats)
        again.append(again_at[d] or d in seen)
        seen.add(d)
    gone = [False] * len(found)

    def close(lo: int, hi: int, enough: int) -> None:
        if all(again[lo:hi]) and sum(len(found[i][2]) for i in range(lo, hi)) >= enough:
            gone[lo:hi] = [True] * (hi - lo)

    line = run = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or text.find("\n", found[i - 1][1], found[i][0]) >= 0:
            close(line, i, 0)
            line = i
        if i == len(found) or again[i] != again[i - 1]:
            close(run, i, least)
            run = i
    out: list[tuple[int, int]] = []
    for i, (start, end, _) in enumerate(found):
        if gone[i]:
            out[-1:] = [(out[-1][0], end)] if i and gone[i - 1] else [*out[-1:], (start, end)]
    return out


def without(text: str, left_out: list[tuple[int, int]]) -> str:
    """The text without the spans and the white space that follows each."""
    parts, at = [], 0
    for start, end in left_out:
        parts.append(text[at:start])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return "".join([*parts, text[at:]])


_CLEAN = "doc_id long, text string, removed array<struct<start: long, end: long>>, n_removed long"


def _clean(least: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, places in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                found = spans(text, set(places or ()), least) if text else []
                texts.append(without(text, found) if found else text)
                removed.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, span),
                 pa.array([sum(s["end"] - s["start"] for s in r) for r in removed], pa.int64())],
                ["doc_id", "text", "removed", "n_removed"])
    return run


def dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed, n_removed) per row of docs: the text without its repeats, their spans in the original
    text (code points, end exclusive), and how many characters they hold.

    The least id ranks first; a null id ranks last. Rows of one id are one text's copies and rank alike, so they keep
    or lose the same. A null text stays null, an empty one empty. A text whose every unit repeats becomes empty.
    Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("rank", F.coalesce("doc_id", F.lit(_LAST)))
    found = cut(base.select("rank", "text").mapInArrow(_hash, _UNITS))
    shared = found.groupBy("hi", "lo").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = found.join(shared.select("hi", "lo", "first"), ["hi", "lo"]).where("rank > first")
    places = repeats.groupBy("rank", "version").agg(F.collect_set("place").alias("places"))
    held = base.withColumn("version", F.crc32(F.coalesce("text", F.lit("")))).join(places, ["rank", "version"], "left")
    return held.select("doc_id", "text", "places").mapInArrow(_clean(least), _CLEAN)
