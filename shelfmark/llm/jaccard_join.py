"""N-gram Jaccard join over a count-vector R-tree.

A document is the set of its word shingles, each a 64-bit hash. The shingles fall into GROUPS groups by hash, and
the group counts are the document's point: for two documents the shared shingles number at most the sum over groups
of the smaller count. Two sets link when 100 * |A & B| >= percent * |A | B|, so a pair whose summed minima fall
below the overlap this asks for is dropped, and the rest are verified on the sets.

The index is spread over shards. Two linking sets differ in few shingles, so when the hash range is dealt into more
parts than that, some part is equal in both: a document is filed under each of its parts (part, content), and the
shard of a part holds every document with just that content there. Up to SIGNATURES parts every part is filed and
none can be missed (a part empty in both tells nothing, so documents with too many empty parts are dealt again
under another seed). Longer documents file SIGNATURES parts, each of which survives the largest allowed difference
with a chance of 0.35 or more: a linking pair is missed with a chance below 1e-8.

In a shard every point is first held against the shard's least document. Copies hang together after that, and only
shards whose documents still lie in different components are walked again, with an R-tree over the points, in
blocks of BLOCK points: pairs of different components only, so a group of copies is never expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import beside, components, cut, discard

GROUPS = 64
SIGNATURES = 48
SEEDS = 6
BLOCK = 1024
LEAF = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lowered, words split at ASCII white space. Fewer words than
    the width: the whole sequence is one shingle. No words: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = mixed(acc * _ODD + h[i:i + n])
    return np.unique(acc)


def gap(size_a, size_b, percent: int):
    """The most shingles two linking sets of these sizes can differ in."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def overlap(size_a, size_b, percent: int):
    """The fewest shingles two linking sets of these sizes share."""
    return -((-percent * (size_a + size_b)) // (100 + percent))


def _signatures(s: np.ndarray, percent: int) -> list[np.ndarray]:
    n, found = len(s), []
    widest = 100 * n // percent
    if gap(n, widest, percent) < 1:
        return found
    low = n.bit_length() - 1
    for band in range(low, widest.bit_length()):
        parts = 11 * gap(2 << band, 2 << band, percent) // 10 + 2
        for seed in range(SEEDS):
            salt = np.uint64((band * SEEDS + seed + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            # Only the filed parts are summed up; `place` is even over the hash range.
            own = mixed(s + salt)
            place = (own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            filled = len(np.unique(place))
            keep = place < SIGNATURES
            where, own = place[keep], own[keep]
            order = np.argsort(where, kind="stable")
            where, own = where[order], own[order]
            if len(where):
                starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                tag = where[starts] + mixed(np.array([salt]))
                found.append(mixed(np.add.reduceat(own, starts) ^ mixed(tag)))
            if parts > SIGNATURES or filled > gap(n, widest, percent):
                break
    return found


def point(s: np.ndarray) -> bytes:
    """Group counts, in the least of one, two and four bytes each that holds them."""
    counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    top = counts.max()
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_hi", pa.int64()),
                      ("print_lo", pa.int64()), ("point", pa.binary()), ("signatures", pa.list_(pa.int64()))])


def _profile(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), width)
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                sigs = _signatures(s, percent)
                flat = np.unique(np.concatenate(sigs)).view(np.int64) if sigs else np.empty(0, np.int64)
                rows.append((doc, len(s), (both >> 64) - 2**63, (both & 2**64 - 1) - 2**63, point(s), flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PROFILE)] if rows else
                [pa.array([], f.type) for f in _PROFILE], schema=_PROFILE)
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingle_set"])
    return run


def _points(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    sizes = np.array([len(x) // GROUPS for x in rows], np.int64)
    out = np.empty((len(rows), GROUPS), np.int64)
    for width in (1, 2, 4):
        at = np.flatnonzero(sizes == width)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<u{width}").reshape(-1, GROUPS)
    return out


def _near_points(percent: int):
    """Keeps the pairs whose summed minima reach the needed overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _points(batch.column("point_a")), _points(batch.column("point_b"))
            good = np.minimum(a, b).sum(1) >= overlap(a.sum(1), b.sum(1), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


class Tree:
    """An R-tree over count points, packed in one go: leaves of LEAF points, each level LEAF times smaller.

    A node keeps the coordinate maxima of what lies below it and the sizes' range, so the summed minima against a
    query bound the overlap with every point below."""

    def __init__(self, points: np.ndarray):
        sizes = points.sum(1)
        lead = points[:, :8].argmax(1) if len(points) else sizes
        self.order = np.lexsort((sizes, lead, np.round(np.log2(sizes + 1) * 4)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, small = self.points, self.sizes
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high, small = np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts)
            self.levels.append((high, small))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Indexes of the points that may link with the query."""
        size, live = query.sum(), None
        for high, small in reversed(self.levels):
            live = np.arange(len(high)) if live is None else live[live < len(high)]
            live = live[np.minimum(high[live], query).sum(1) >= overlap(size, small[live], percent)]
            live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
        live = np.arange(len(self.points)) if live is None else live[live < len(self.points)]
        good = np.minimum(self.points[live], query).sum(1) >= overlap(size, self.sizes[live], percent)
        return self.order[live[good]]


def _walk(percent: int):
    """One block pair of a shard: points of the left block are looked up in a tree over the right one. A pair that
    shares several shards comes out of the lowest alone; `lower` holds a document's shards below this one."""
    def run(part: pa.Table) -> pa.Table:
        left, right = (part.filter(pc.equal(part["side"], side)) for side in (0, 1))
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            tree = Tree(_points(right["point"].combine_chunks()))
            ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
            in_a, in_b = left["component"].to_numpy(), right["component"].to_numpy()
            met_a, met_b = ([frozenset(x) for x in side["lower"].to_pylist()] for side in (left, right))
            for i, query in enumerate(_points(left["point"].combine_chunks())):
                hits = tree.search(query, percent)
                hits = [j for j in hits[in_b[hits] != in_a[i]] if met_a[i].isdisjoint(met_b[j])]
                found_a.append(np.minimum(ids_a[i], ids_b[hits]))
                found_b.append(np.maximum(ids_a[i], ids_b[hits]))
        a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).group_by(["a", "b"]).aggregate([])
    return run


def join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: component_id is the smallest id reachable by links.

    Null, empty and wordless texts have no shingles and link with nothing; equal sets always link. An id names one
    text: repeated rows give repeated result rows. A null id takes part in no link and is its own component (null).
    Other columns of docs are not read, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, print_hi long, print_lo long, point binary, signatures array<long>"
    profile = cut(base.mapInArrow(_profile(width, percent), schema))
    usable = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal points and signatures, so a class is one aggregation and any of its rows tells them.
    one = usable.groupBy("print_hi", "print_lo").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("point").alias("point"), F.any_value("signatures").alias("signatures"))
    wide, profile = profile, cut(profile.select("doc_id", "n_shingles", "print_hi", "print_lo"))
    reps = cut(one)
    classes = reps.select("print_hi", "print_lo", F.col("doc_id").alias("rep"))
    discard(wide)
    filed = reps.select(F.col("doc_id").alias("id"), F.explode("signatures").alias("shard"))
    shards = cut(filed.groupBy("shard").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    members = cut(filed.join(shards, "shard").select("shard", "a", "n", "id"))
    points = reps.select("doc_id", "point")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the bound, then those that link."""
        near = (pairs.join(points.select(F.col("doc_id").alias("a"), F.col("point").alias("point_a")), "a")
                .join(points.select(F.col("doc_id").alias("b"), F.col("point").alias("point_b")), "b")
                .mapInArrow(_near_points(percent), "a long, b long"))
        near = cut(near)
        wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = base.join(beside(wanted, F.lit(8)), "doc_id").mapInArrow(_sets(width), "doc_id long, shingle_set binary")
        sets = cut(sets.dropDuplicates(["doc_id"]))
        return cut(near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingle_set").alias("set_b")), "b")
                   .join(sets.select(F.col("doc_id").alias("a"), F.col("shingle_set").alias("set_a")), "a")
                   .mapInArrow(_verify(percent), "a long, b long"))

    links = verified(members.where("a <> id").select("a", F.col("id").alias("b")).distinct())
    held = cut(components(links))
    placed = members.join(held, members["id"] == held["node"], "left").select(
        "shard", "n", "id", F.coalesce("component", "id").alias("component"))
    open_shards = placed.groupBy("shard").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_shards = open_shards.where("lo <> hi").select("shard")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = (placed.join(open_shards, "shard").join(reps, F.col("id") == F.col("doc_id"))
              .withColumn("lower", F.expr("filter(signatures, x -> x < shard)"))
              .withColumn("own", (F.pmod(F.xxhash64("id"), blocks)).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))))
    sides = spread.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id",
                          "component", "point", "lower", F.explode(
                              F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1)))
                              .when(F.col("own") < F.col("other"), F.array(F.lit(0)))
                              .otherwise(F.array(F.lit(1)))).alias("side"))
    late = sides.groupBy("shard", "i", "j").applyInArrow(_walk(percent), "a long, b long").distinct()
    links = links.union(verified(late.join(links, ["a", "b"], "left_anti")))
    reached = components(links)
    named = classes.join(reached, classes["rep"] == reached["node"], "left").select(
        "print_hi", "print_lo", F.coalesce("component", "rep").alias("of"))
    return profile.join(named, ["print_hi", "print_lo"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("of", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
