"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and texts are read as lower-cased words. Every SEED-gram of an item is looked up in every text; hits that
lie within an item's length of each other make one passage. A gram's rarity is the number of texts that hold it; an
item's seeds are its rarer grams (up to its own median, so that every item keeps half of them even when a leak has
made all of them frequent). Two grams of an item in one passage are a seed too, however frequent each is: edited
copies keep the grams that whole copies have made frequent. A passage is kept only where it holds as many of the
item's words as a leak has to match, which no common phrase does, so what is written follows the leaks and not the
items times the texts. Passages with a seed are aligned with the item word by word (match 1, mismatch and gap -1); the
local score over the item's length is the leak's share, and passages from SHARE on are leaks. What an alignment
leaves on either side is aligned again, and long passages are aligned a few item lengths at a time.

The benchmark goes to the workers in blocks of at most BLOCK words, one pass over the texts for each, so what is
broadcast is bounded for a benchmark of any size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

SEED = 3
SHARE = 0.3
LEAST = 6
BLOCK = 500_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Items:
    """A block of test items: their words as numbers, and where each gram of SEED words stands."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items, vocabulary = items, {}
        self.coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in items]
        self.vocabulary = vocabulary
        self.span = max((len(x) for x in self.coded), default=0)
        held: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # An item shorter than SEED words has one gram, the whole of it.
        self.widths = sorted({min(SEED, len(x)) for x in self.coded if len(x)})
        for i, x in enumerate(self.coded):
            width = min(SEED, len(x))
            for code in sorted(set(self.codes(x, width).tolist())) if width else ():
                held[code].append(i)
        self.grams = np.array(sorted(held), np.int64)
        self.of = [held[g] for g in self.grams.tolist()]

    def codes(self, x: np.ndarray, width: int) -> np.ndarray:
        """Grams as numbers; those with a foreign word (-1) are -1."""
        n, base = len(x) - width + 1, len(self.vocabulary) + 1
        if n < 1:
            return np.empty(0, np.int64)
        code, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            part = x[i:i + n]
            code, whole = code * base + part + 1, whole & (part >= 0)
        return np.where(whole, code, -1)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best local alignment, in the text's words; the earliest of equal ones."""
    n, idx = len(text), np.arange(len(text) + 1)
    rows = np.zeros((len(item) + 1, n + 1), np.int32)
    for i, w in enumerate(item):
        best = np.maximum(rows[i, :-1] + np.where(text == w, 1, -1), rows[i, 1:] - 1)
        own = np.maximum(np.r_[0, best], 0)
        # Gaps in the item run along the row: the best start, less its distance.
        rows[i + 1] = np.maximum.accumulate(own + idx) - idx
    score = int(rows.max(initial=0))
    if not score:
        return 0, 0, 0
    end = int(np.flatnonzero(rows.max(0) == score)[0])
    i, j = int(np.flatnonzero(rows[:, end] == score)[0]), end
    while rows[i, j] > 0:
        if rows[i, j] == rows[i - 1, j - 1] + (1 if text[j - 1] == item[i - 1] else -1):
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, j, end


WIDTHS = 8


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """As `align`, in windows of WIDTHS item lengths. An alignment of positive score matches more words than it skips,
    so it takes less than twice the item's words of the text, by which windows overlap."""
    size, step = WIDTHS * len(item), (WIDTHS - 2) * len(item)
    best = (0, 0, 0)
    for lo in range(0, max(len(text) - 2 * len(item), 1), step):
        score, first, end = align(item, text[lo:lo + size])
        if score > best[0]:
            best = score, lo + first, lo + end
    return best


def alignments(item: np.ndarray, text: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(score, first word, end word) of alignments that reach `need`: the best one, then those of what it leaves on
    either side."""
    found, waiting = [], [(0, len(text))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < need or np.isin(item, text[lo:hi]).sum() < need:
            continue
        score, first, end = best_alignment(item, text[lo:hi])
        if score >= need:
            found.append((score, lo + first, lo + end))
            waiting += [(lo + end, hi), (lo, lo + first)]
    return sorted(found, key=lambda x: x[1])


def needed(length: int, share: float) -> int:
    """The score a leak of an item of that many words reaches."""
    return min(length, max(LEAST, int(np.ceil(share * length))))


_FOUND = "doc_id long, item int, grams array<int>, start long, passage string"


def _seek(shared, share: float):
    """Passages of each text that hold grams of an item, widened by the item's length on both sides, and enough of its
    words; beside them one row per text with all grams it holds (no item, no passage), for their frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        number, grams = items.vocabulary, items.grams
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                lower = text.lower()
                found = _WORD.findall(lower)
                x = np.fromiter((number.get(w, -1) for w in found), np.int64, len(found))
                hits = defaultdict(list)
                for width in items.widths:
                    codes = items.codes(x, width)
                    at = np.flatnonzero(codes >= 0)
                    place = np.searchsorted(grams, codes[at])
                    good = grams[np.minimum(place, len(grams) - 1)] == codes[at]
                    for where, g in zip(at[good].tolist(), place[good].tolist()):
                        for i in items.of[g]:
                            if min(SEED, len(items.coded[i])) == width:
                                hits[i].append((where, g))
                if not hits:
                    continue
                # Lowering may change a text's length; offsets are then those of the words in the text as it is.
                spans = [m.span() for m in _WORD.finditer(text if len(lower) == len(text) else lower)]
                out.append((doc, None, sorted({g for own in hits.values() for _, g in own}), None, None))
                for i, own in hits.items():
                    length, lo = len(items.coded[i]), 0
                    need = needed(length, share)
                    own.sort()
                    for k in range(1, len(own) + 1):
                        if k == len(own) or own[k][0] - own[k - 1][0] > length:
                            a = max(0, own[lo][0] - length)
                            b = min(len(spans), own[k - 1][0] + length + SEED)
                            if np.isin(items.coded[i], x[a:b]).sum() >= need:
                                start, end = spans[a][0], spans[b - 1][1]
                                out.append((doc, i, sorted({g for _, g in own[lo:k]}), start,
                                            (text if len(lower) == len(text) else lower)[start:end]))
                            lo = k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.string()))],
                    ["doc_id", "item", "grams", "start", "passage"])
    return run


def _judge(shared, share: float):
    """Passages with a seed, aligned with their item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value
        for batch in batches:
            out = []
            for doc, i, grams, start, passage in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if len(grams) < 2 and seeds[i].isdisjoint(grams):
                    continue
                item = items.coded[i]
                spans = [m.span() for m in _WORD.finditer(passage)]
                text = np.array([items.vocabulary.get(passage[a:b].lower(), -1) for a, b in spans], np.int64)
                for score, first, end in alignments(item, text, needed(len(item), share)):
                    out.append((doc, items.items[i][0], score, score / len(item), start + spans[first][0], start + spans[end - 1][1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    ["doc_id", "item_id", "score", "share", "start", "end"])
    return run


_LEAK = "doc_id long, item_id long, score long, share double, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, share, start, end) of every passage that leaks a test item.

    start and end are code points of the text (of its lower-cased form where lowering changes its length). A text
    that leaks an item twice gives two rows, however near to each other; repeated rows of docs give their rows each. Null and empty texts and
    items, and items without words, match nothing. A null doc_id is kept as it is. Items of under SEED words are
    found as a whole phrase. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = cut(benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")))
    # Words are at most half of the characters, and one more.
    size = tests.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    blocks, found = max(1, int(-(-size // BLOCK))), []
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().sort_by(
            [("item_id", "ascending"), ("text", "ascending")])
        items = Items([(i, words(t)) for i, t in zip(own["item_id"].to_pylist(), own["text"].to_pylist())])
        if not len(items.grams):
            continue
        passages = cut(base.mapInArrow(_seek(spark.sparkContext.broadcast(items), share), _FOUND))
        held = passages.where("item IS NULL").select(F.explode("grams").alias("gram")).groupBy("gram").agg(
            F.count("*").alias("n")).toArrow()
        n = dict(zip(held["gram"].to_pylist(), held["n"].to_pylist()))
        by_item: dict[int, list[int]] = defaultdict(list)
        for g, of in enumerate(items.of):
            for i in of:
                by_item[i].append(g)
        seeds = [set() for _ in items.coded]
        for i, gs in by_item.items():
            gs.sort(key=lambda g: (n.get(g, 0), g))
            bar = n.get(gs[(len(gs) - 1) // 2], 0)
            seeds[i] = {g for g in gs if n.get(g, 0) <= bar}
        found.append(passages.where("item IS NOT NULL").mapInArrow(_judge(spark.sparkContext.broadcast((items, seeds)), share), _LEAK))
    if not found:
        return spark.createDataFrame([], _LEAK)
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole
