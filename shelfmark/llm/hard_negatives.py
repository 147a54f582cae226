"""Hard negatives by Kronecker-packed integer products.

Components become integers. Candidates' components, biased to be non-negative, are laid into separated fields of one
wide integer; a multiplication by an anchor's component then multiplies them all, and after the sum over components
every field holds one candidate's exact inner product. Fields are as wide as the block's own values need, so that no
sum can reach its neighbour. As many as 53 bits hold share an integer that a double carries exactly, which lets the
matrix product of doubles do the multiplications; values too wide for that share Python's unbounded integers.

Anchors meet all rows. They go to the workers in passes of at most PASS_BYTES, each reading the table twice: once for
an anchor's best rows of its own label, once for the rows of other labels inside the bands those set. A task keeps the
best few of each anchor while it reads, so only those are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

PASS_BYTES = 32_000_000
ANCHOR_BLOCK = 512
FIRST_ROWS, MOST_ROWS = 256, 4096
EXACT_BITS = 53
WIDE_FIELDS = 8
_LEAST = np.iinfo(np.int64).min + 1  # its negative is a long too

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows down and anchors across, of two integer matrices."""
    bias = int(np.abs(rows).max(initial=0))
    reach = int(np.abs(anchors).sum(1).max(initial=0))
    width = (2 * bias * reach + 1).bit_length() + 1
    fields = EXACT_BITS // width
    kind, fields = (np.float64, fields) if fields else (object, WIDE_FIELDS)
    whole = -(-len(rows) // fields) * fields
    biased = np.zeros((whole, rows.shape[1]), np.int64)
    biased[:len(rows)] = rows + bias
    biased = biased.reshape(-1, fields, rows.shape[1]).astype(kind)
    wide = biased[:, 0]
    for i in range(1, fields):
        wide = wide + biased[:, i] * kind(1 << width * i) if kind is np.float64 else wide + biased[:, i] * (1 << width * i)
    middle = sum(1 << width * i + width - 1 for i in range(fields))
    sums = wide @ anchors.T.astype(kind) + middle
    sums = sums.astype(np.int64) if kind is np.float64 else sums
    out = np.empty((len(wide), fields, len(anchors)), np.int64)
    shift = (1 << width - 1) + bias * anchors.sum(1).astype(object if kind is object else np.int64)
    for i in range(fields):
        out[:, i] = ((sums >> width * i) & ((1 << width) - 1)) - shift
    return out.reshape(whole, len(anchors))[:len(rows)]


def _quantised(scale: int):
    """Vectors as floor(scale * x); those that hold a null or non-finite component, are null or empty, or are too long
    for the products to fit 62 bits go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("vector")), 0)
            batch = batch.filter(pc.greater(size, 0))
            column = batch.column("vector")
            ends = np.cumsum(np.r_[0, pc.list_value_length(column).to_numpy(zero_copy_only=False)]).astype(np.int64)
            if not batch.num_rows:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                norm = np.add.reduceat(x * x, ends[:-1])
            kept = np.flatnonzero(norm < 2.0 ** 62)  # false for what is not a number
            whole = np.where(np.abs(x) < 2.0 ** 31, x, 0).astype("<i4").tobytes()
            packed = pa.array([whole[4 * ends[i]:4 * ends[i + 1]] for i in kept], pa.binary())
            rest = batch.select(["row", "label", "anchor"]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*rest.columns, packed], ["row", "label", "anchor", "q"])
    return run


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, length).astype(np.int64)


class _Best:
    """The k best (score descending, row ascending) of each of n keys, over all entries added."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.rows = np.full((n, k), _LEAST), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def may_enter(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (score > self.scores[key, -1]) | ((score == self.scores[key, -1]) & (row < self.rows[key, -1]))

    def add(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(key):
            return
        touched = np.unique(key)
        key = np.r_[np.repeat(touched, self.k), key]
        score, row = np.r_[self.scores[touched].ravel(), score], np.r_[self.rows[touched].ravel(), row]
        order = np.lexsort((row, -score, key))
        key, score, row = key[order], score[order], row[order]
        starts = np.searchsorted(key, touched)
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        top = place < self.k
        self.scores[key[top], place[top]], self.rows[key[top], place[top]] = score[top], row[top]

    def filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.scores > _LEAST)
        return key, self.scores[key, place], self.rows[key, place]


class _Anchors:
    """One pass of anchors: ids, labels, and their vectors by length."""

    def __init__(self, found: pa.Table):
        self.id = found["row"].to_numpy()
        labels = found["label"].to_pylist()
        self.code = {x: i for i, x in enumerate(sorted(set(labels)))}
        self.label = np.array([self.code[x] for x in labels], np.int64)
        sizes = np.array([len(x) // 4 for x in found["q"].to_pylist()])
        self.vectors = {}
        for n in map(int, np.unique(sizes)):
            at = np.flatnonzero(sizes == n)
            self.vectors[n] = at, _matrix(found["q"].take(pa.array(at)), n)

    def met(self, batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[tuple]:
        """(anchors' places, their vectors, rows, labels, vectors) by length, in runs of rows that grow as the bests
        fill. apart: a run holds one label and its anchors only."""
        most = FIRST_ROWS
        for batch in batches:
            sizes = pc.divide(pc.binary_length(batch.column("q")), 4).to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            labels = np.array([self.code.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
            for n, (places, vectors) in self.vectors.items():
                held = np.flatnonzero(sizes == n)
                lo = 0
                while lo < len(held):
                    at = held[lo:lo + most]
                    lo, most = lo + most, min(2 * most, MOST_ROWS)
                    q = _matrix(batch.column("q").take(pa.array(at)), n)
                    for label in np.unique(labels[at]) if apart else [None]:
                        some = labels[at] == label if apart else np.ones(len(at), bool)
                        own = np.flatnonzero(self.label[places] == label) if apart else np.arange(len(places))
                        for a in range(0, len(own), ANCHOR_BLOCK):
                            block = own[a:a + ANCHOR_BLOCK]
                            yield places[block], vectors[block], rows[at][some], labels[at][some], q[some]


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = _Best(len(anchors.id), k)
        for places, vectors, rows, _, q in anchors.met(batches, apart=True):
            scores = packed_products(q, vectors)
            who, where = np.nonzero(scores >= best.least[places])
            key, score, row = places[where], scores[who, where], rows[who]
            good = (row != anchors.id[key]) & best.may_enter(key, score, row)
            best.add(key[good], score[good], row[good])
        key, score, row = best.filled()
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(score), pa.array(row)], ["at", "score", "row"])
    return run


def _negatives(shared, k: int, low: int, high: int):
    """Bands are (anchor, slot) keys: a positive's own range of scores for its negatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, positive, score_of = shared.value
        slots = positive.shape[1]
        held = score_of >= 0  # a negative positive score leaves an empty band
        wide = score_of.astype(object)  # a hundred times a score may not fit a long
        floor = np.where(held, -(-low * wide // 100), np.iinfo(np.int64).max).astype(np.int64)
        ceiling = np.where(held, high * wide // 100, _LEAST).astype(np.int64)
        best = _Best(positive.size, k)
        for places, vectors, rows, labels, q in anchors.met(batches, apart=False):
            scores = packed_products(q, vectors)
            keys = places[:, None] * slots + np.arange(slots)
            least = np.maximum(floor[places], best.least[keys])
            who, where = np.nonzero((scores >= least.min(1)) & (scores <= ceiling[places].max(1)))
            differ = labels[who] != anchors.label[places[where]]
            who, where = who[differ], where[differ]
            score, row = scores[who, where], rows[who]
            for slot in range(slots):
                key = keys[where, slot]
                good = (score >= floor[places[where], slot]) & (score <= ceiling[places[where], slot])
                good &= best.may_enter(key, score, row)
                best.add(key[good], score[good], row[good])
        key, score, row = best.filled()
        at, slot = key // slots, key % slots
        yield pa.RecordBatch.from_arrays([
            pa.array(at, pa.int32()), pa.array(slot, pa.int32()), pa.array(anchors.id[at]), pa.array(positive[at, slot]),
            pa.array(score_of[at, slot]), pa.array(row), pa.array(score)],
            ["at", "slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str | Column = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x), a score is the integer inner product, higher ones come first and ties
    go to the smaller id. Anchors are the rows where `anchors` is true. For each of an anchor's first `positives`
    rows of its label (rows of its own id are not others) come the first `negatives` rows of different labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; there may be none.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a vector whose product
    with itself needs more than 62 bits take no part. Vectors of unequal lengths have no score. Rows that repeat
    count as often as they occur, as anchors too. An empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    base = rows.select(F.col(id_col).cast("long").alias("row"), label.cast("string").alias("label"),
                       F.coalesce(anchors, F.lit(False)).alias("anchor"),
                       F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.where("row IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    base = cut(base.mapInArrow(_quantised(scale), "row long, label string, anchor boolean, q binary"))
    size = base.where("anchor").agg(F.sum(2 * F.length("q") + 24 * (positives + 1))).first()[0] or 0
    passes = math.ceil(size / PASS_BYTES)
    if not passes:
        return spark.createDataFrame([], _RESULT)
    turn = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(passes))
    asked = cut(base.where("anchor").select("row", "label", "q", turn.alias("turn")))
    mined = []
    for i in range(passes):
        found = asked.where(F.col("turn") == i).drop("turn").toArrow().sort_by([(c, "ascending") for c in ("row", "label", "q")])
        if not found.num_rows:
            continue
        held = _Anchors(found)
        shared = spark.sparkContext.broadcast(held)
        near = base.mapInArrow(_positives(shared, positives), "at int, score long, row long")
        order = Window.partitionBy("at").orderBy(F.desc("score"), "row")
        near = near.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives).toArrow()
        positive, score = np.zeros((found.num_rows, positives), np.int64), np.full((found.num_rows, positives), -1, np.int64)
        place = near["at"].to_numpy(), near["slot"].to_numpy()
        positive[place], score[place] = near["row"].to_numpy(), near["score"].to_numpy()
        bands = spark.sparkContext.broadcast((held, positive, score))
        hard = base.mapInArrow(_negatives(bands, negatives, low, high), "at int, slot int, anchor_id long, positive_id long, "
                               "positive_score long, negative_id long, negative_score long")
        order = Window.partitionBy("at", "slot").orderBy(F.desc("negative_score"), "negative_id")
        hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        mined.append(cut(hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                     "positive_score", "negative_score")))
        shared.unpersist()
        bands.unpersist()
    out = mined[0]
    for more in mined[1:]:
        out = out.union(more)
    return out
