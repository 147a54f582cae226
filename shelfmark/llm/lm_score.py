"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training texts. A count c is quantised to level
floor(log2(c)), and the filter holds (n-gram, 0) to (n-gram, level); repeated membership probes, level by level until
one fails, give the quantised count back. A pair can be no more frequent than its words, so pairs of words never seen
are not probed and an estimate never exceeds its words' counts. P(w | v) interpolates the pair estimate with the
add-one word estimate.

The filter takes BITS_EACH bits for every entry there is, in a segment per bucket (the hash's leading bits). Up to
MAX_BITS (8 MB) it is broadcast. Beyond, each segment stays beside its bucket: the distinct words and pairs of a run of texts
are sent to their buckets in one round, probed there, and the levels sent back, with the exact counts of the words.
Both ways give the same scores, and the number of buckets follows the bytes of the texts, so scores don't depend on how
docs is partitioned. Exact word counts are broadcast for words that make up at least 1 / HEAVY of all tokens, of which
there are at most HEAVY; others are joined, or come with the levels. Hashes and numbers move as differences in
compressed byte planes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.jaccard_join import mixed

HEAVY = 1 << 20
MAX_BITS = 1 << 26
BITS_EACH = 14
PROBES = 8
WEIGHT = 0.1
GATHER = 3_000_000
CHUNK = 800_000
BUCKET_BYTES = 1 << 26
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_LOG = logging.getLogger(__name__)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, len(planes) // wide).T).reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising unsigned numbers as their differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def words(text: str | None) -> np.ndarray:
    """Hashes of the words and the end mark. No word holds white space, so the mark meets none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.append(h, _END)


def pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash per position of (word before, word); what stands before a text is the end of another."""
    before = np.roll(h, 1)
    before[first] = _END
    return mixed(before * _ODD + h)


def _group(h: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[starts], np.add.reduceat(counts, starts) if len(h) else counts


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _rest(h: np.ndarray, split: int) -> np.ndarray:
    """The 32 bits after the bucket's: what is kept of a pair."""
    return ((h >> np.uint64(32 - split)) & _LOW).astype("<u4")


def _gather(bits: int):
    """Counts of the words and pairs of a run of training texts, packed by bucket (the hash's leading bits)."""
    def packed(kind: int, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = _group(h)
        where = (keys >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.searchsorted(where, np.arange((1 << bits) + 1))
        rows = []
        for bucket in np.unique(where):
            lo, hi = edges[bucket], edges[bucket + 1]
            own = keys[lo:hi] if kind == 1 else _rest(keys[lo:hi], bits)
            rows.append((int(bucket), kind, pack_sorted(own), pack(counts[lo:hi].astype("<u4"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(words(text.as_py()))
                size += len(held[-1])
                if size >= GATHER:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        first = np.cumsum([0] + [len(x) for x in held[:-1]])
        yield from packed(1, h)
        yield from packed(2, pairs(h, first))
    return run


def level(counts: np.ndarray) -> np.ndarray:
    """0 below 2, then 1 + floor(log2(c / 2))."""
    return np.where(counts < 2, 0, np.frexp(np.maximum(counts, 1).astype(float))[1] - 1).astype(np.int64)


def _merge(part: pa.Table) -> pa.Table:
    """One bucket: its word counts in full, and the pairs with their levels."""
    bucket, kinds = part["bucket"][0].as_py(), part["kind"].to_numpy()
    keys, counts = part["keys"].to_pylist(), part["counts"].to_pylist()

    def own(kind: int, dtype: str):
        at = np.flatnonzero(kinds == kind)
        return _group(np.concatenate([np.empty(0, dtype), *(unpack_sorted(keys[i], dtype) for i in at)]),
                      np.concatenate([np.empty(0, np.int64), *(unpack(counts[i], "<u4").astype(np.int64) for i in at)]))

    h, c = own(1, "<u8")
    p, n = own(2, "<u4")
    levels = level(n)
    both = np.concatenate([levels, level(c)])
    tally = np.bincount(both, minlength=64)[:64]
    return pa.table({
        "bucket": pa.array([bucket], pa.int32()), "words": pa.array([pack_sorted(h)], pa.binary()),
        "counts": pa.array([pack(c.astype("<i8"))], pa.binary()),
        "pairs": pa.array([pack_sorted(p)], pa.binary()),
        "levels": pa.array([pack(levels.astype("u1"))], pa.binary()),
        "tokens": pa.array([int(c.sum())], pa.int64()), "distinct": pa.array([len(h)], pa.int64()),
        "tally": pa.array([tally.tolist()], pa.list_(pa.int64()))})


def _places(x: np.ndarray, lev: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, level) in its segment, one probe at a time."""
    h = mixed(x + np.uint64(lev * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h & _LOW) + np.uint64(i) * step) % np.uint64(bits)


def _word_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(0x51ED270B))


def _pair_keys(bucket: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    return mixed((np.asarray(bucket).astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64))


def _segments(bits: int):
    """The filter's segment of each bucket, beside its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for bucket, h, c, p, lev in zip(*(batch.column(i).to_pylist() for i in range(5))):
                segment = np.zeros(bits, np.uint8)
                for x, n in ((_word_keys(unpack_sorted(h, "<u8")), level(unpack(c, "<i8"))),
                             (_pair_keys(bucket, unpack_sorted(p, "<u4")), unpack(lev, "u1").astype(np.int64))):
                    for j in range(int(n.max(initial=-1)) + 1):
                        for place in _places(x[n >= j], j, bits):
                            segment[place.astype(np.int64)] = 1
                made.append(np.packbits(segment, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(1), batch.column(2)],
                                             ["bucket", "segment", "words", "counts"])
    return run


class Filter:
    """Probes of segments of equal size, one per bucket, for the levels from `least` on."""

    def __init__(self, segments: np.ndarray, bits: int, split: int, least: int):
        self.segments, self.bits, self.split, self.least = segments, bits, split, least

    def levels(self, keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The quantised level of each n-gram: the last of the levels in a row that are all found, least - 1 for none."""
        found, live = np.full(len(keys), self.least - 1, np.int64), np.arange(len(keys))
        base, stride, j = buckets.astype(np.int64), self.bits // 8, self.least
        while len(live):
            h, at, step = keys[live], live, np.uint64(j * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
            for i in range(PROBES):
                # Probes after the first only look at what passed so far.
                if not len(at):
                    break
                x = mixed(h + step)
                place = (((x & _LOW) + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64)
                hit = (self.segments[base[at] * stride + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
                h, at = h[hit], at[hit]
            found[at] = j
            live, j = at, j + 1
        return found


def _estimate(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, on the log scale; levels are -1 for what is not there."""
    return np.where(levels > 0, 2.0 ** (levels + 0.5), np.where(levels == 0, 1.0, 0.0))


_SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, gain double, "
           "rare array<long>, times array<int>")


class Chunk:
    """A run of texts: sizes, its distinct words u with exact counts for some, which of u stands where (back), and its
    distinct pairs."""

    def __init__(self, sizes: np.ndarray, u: np.ndarray, back: np.ndarray, heavy: np.ndarray, counts: np.ndarray):
        self.sizes, self.u, self.back = sizes, u, back
        self.first = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.minimum(np.searchsorted(heavy, u), max(len(heavy) - 1, 0))
        self.exact = heavy[at] == u if len(heavy) else np.zeros(len(u), bool)
        self.c = np.zeros(len(u))
        self.c[self.exact] = counts[at[self.exact]]
        self.rare = np.flatnonzero(~self.exact)
        self.pairs, self.pair = np.unique(pairs(u[back], self.first), return_inverse=True)

    def record(self) -> tuple[bytes, bytes, bytes]:
        """Sizes, words by falling frequency, and which of them stands where: small numbers, most of them."""
        order = np.argsort(-np.bincount(self.back, minlength=len(self.u)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype="<u4")
        return pack(self.sizes.astype("<i8")), pack(self.u[order]), pack(place[self.back])

    @classmethod
    def opened(cls, sizes: bytes, u: bytes, back: bytes, heavy: np.ndarray, counts: np.ndarray) -> Chunk:
        u = unpack(u, "<u8")
        order = np.argsort(u)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(unpack(sizes, "<i8"), u[order], place[unpack(back, "<u4")], heavy, counts)

    def rows(self, of_words: np.ndarray, of_pairs: np.ndarray, row: int, ids, held, tokens: int, distinct: int,
             weight: float, exact: np.ndarray | None = None) -> pa.RecordBatch:
        """A row per text, from the levels of the rare words and of the pairs. `exact` are the counts of the rare words;
        without them a row holds the rare words for a join."""
        self.c[self.rare] = _estimate(of_words)
        cw = self.c[self.back]
        cv = np.roll(cw, 1)
        # Looked up by its hash: the end mark is in every chunk.
        cv[self.first] = self.c[np.searchsorted(self.u, _END)]
        may = np.flatnonzero((cw >= 1) & (cv >= 1))
        doc, u = np.repeat(np.arange(len(self.sizes)), self.sizes), self.u
        known = self.exact[self.back]
        seen = np.minimum(_estimate(of_pairs)[self.pair[may]], np.minimum(cw[may], cv[may]))
        gain = np.full(len(doc), np.log10(1 - weight))
        single = (cw[may] + 1) / (tokens + distinct + 1)
        gain[may] = np.log10(1 - weight + weight * seen / cv[may] / single)
        logs = np.where(known, np.log10(cw + 1), 0.0)
        n = len(self.sizes)
        left = np.flatnonzero(~known)
        if exact is not None:
            late = np.zeros(len(u))
            late[self.rare] = exact
            logs[left] = np.log10(late[self.back[left]] + 1)
            known[left] = late[self.back[left]] > 0
            left = left[:0]
        key, times = np.unique(doc[left] * np.int64(len(u)) + self.back[left], return_counts=True)
        ends = np.cumsum(np.bincount(key // max(len(u), 1), minlength=n))
        offsets = pa.array(np.r_[0, ends], pa.int32())
        total = lambda x: pa.array(np.bincount(doc, x, n))
        return pa.RecordBatch.from_arrays([
            pa.array(row + np.arange(n)), ids, held, pa.array(self.sizes, pa.int64()),
            pa.array(np.bincount(doc, known, n).astype(np.int64)), total(logs), total(gain),
            pa.ListArray.from_arrays(offsets, pa.array(u[key % max(len(u), 1)].view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        ], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "gain", "rare", "times"])


def _chunks(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """(number of the first row, ids, held_out, chunk) of runs of texts."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, held = batch.column(0), batch.column(1)
        parts, size, lo = [], 0, 0
        for i, text in enumerate(batch.column(2)):
            parts.append(words(text.as_py()))
            size += len(parts[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                u, back = np.unique(np.concatenate(parts), return_inverse=True)
                n = len(parts)
                yield row, ids.slice(lo, n), held.slice(lo, n), Chunk(np.array([len(x) for x in parts]), u, back, heavy, counts)
                row, lo, parts, size = row + n, lo + n, [], 0


def _score(shared, tokens: int, distinct: int, weight: float):
    """Scores by the broadcast filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts, segments, bits, split = shared.value
        probe, shift = Filter(segments, bits, split, 0), np.uint64(64 - split)
        for row, ids, held, chunk in _chunks(batches, heavy, counts):
            rare, bucket = chunk.u[chunk.rare], chunk.pairs >> shift
            of_words = probe.levels(_word_keys(rare), rare >> shift)
            of_pairs = probe.levels(_pair_keys(bucket, _rest(chunk.pairs, split)), bucket)
            yield chunk.rows(of_words, of_pairs, row, ids, held, tokens, distinct, weight)
    return run


_CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes binary, words binary, back binary"
_QUERY = "chunk long, kind int, bucket int, keys binary"
_LEVELS = "chunk long, kind int, bucket int, levels binary, exact binary"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks as rows."""
    none = np.empty(0, np.uint64)
    for row, ids, held, chunk in _chunks(batches, none, none):
        whole = (row, ids.to_pylist(), held.to_pylist(), *chunk.record())
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(whole, kinds)],
                                         ["chunk", "ids", "held", "sizes", "words", "back"])


def _asked(shared):
    """By bucket, the rare words (kind 1) and the pairs (kind 2) of each chunk."""
    def queries(kind: int, keys: np.ndarray, split: int) -> Iterator[tuple]:
        where = (keys >> np.uint64(64 - split)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(keys) else np.empty(0, np.int64)
        for lo, hi in zip(edges, np.r_[edges[1:], len(keys)]):
            yield kind, int(where[lo]), pack_sorted(keys[lo:hi] if kind == 1 else _rest(keys[lo:hi], split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts, split = shared.value
        for batch in batches:
            for number, *record in zip(*(batch.column(i).to_pylist() for i in range(4))):
                chunk = Chunk.opened(*record, heavy, counts)
                asked = [*queries(1, chunk.u[chunk.rare], split), *queries(2, chunk.pairs, split)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(asked), pa.int64()),
                     *(pa.array(c, k) for c, k in zip(zip(*asked), (pa.int32(), pa.int32(), pa.binary())))],
                    ["chunk", "kind", "bucket", "keys"])
    return run


def _probe(bits: int):
    """Levels of what is asked of one bucket, by its segment, and exact counts of words."""
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        made, h, c = (held[n][0].as_py() for n in ("segment", "words", "counts")) if held.num_rows else (b"\0" * (bits // 8), None, None)
        own = unpack_sorted(h, "<u8") if h else np.empty(0, np.uint64)
        counts = np.append(unpack(c, "<i8") if c else np.empty(0, np.int64), 0)
        probe, out, exact = Filter(np.frombuffer(made, np.uint8), bits, 0, 0), [], []
        for kind, bucket, keys in zip(*(asked[c].to_pylist() for c in ("kind", "bucket", "keys"))):
            if kind == 1:
                h = unpack_sorted(keys, "<u8")
                at, x = np.searchsorted(own, h), _word_keys(h)
                exact.append(pack(np.where(np.append(own, _END)[at] == h, counts[at], 0)))
            else:
                x = _pair_keys(bucket, unpack_sorted(keys, "<u4"))
                exact.append(None)
            out.append(pack(probe.levels(x, np.zeros(len(x), np.int64)).astype("i1")))
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "bucket": asked["bucket"],
                         "levels": pa.array(out, pa.binary()), "exact": pa.array(exact, pa.binary())})
    return run


def _finish(shared, tokens: int, distinct: int, weight: float):
    def answer(levels: pa.Table, kind: int, column: str = "levels", dtype: str = "i1") -> np.ndarray:
        """What came back for a chunk's words or pairs, in the order of their keys."""
        found = sorted((b, x) for k, b, x in zip(*(levels[c].to_pylist() for c in ("kind", "bucket", column))) if k == kind)
        return np.concatenate([np.empty(0, np.int64), *(unpack(x, dtype).astype(np.int64) for _, x in found)])

    def run(record: pa.Table, levels: pa.Table) -> pa.Table:
        chunk = Chunk.opened(*(record[c][0].as_py() for c in ("sizes", "words", "back")), *shared.value[:2])
        ids, held = (pa.array(record[c][0].as_py(), k) for c, k in (("ids", pa.int64()), ("held", pa.bool_())))
        return pa.Table.from_batches([chunk.rows(answer(levels, 1), answer(levels, 2), record["chunk"][0].as_py(), ids, held,
                                                 tokens, distinct, weight, answer(levels, 1, "exact", "<i8"))])
    return run


def _score_beside(base: DataFrame, segments: DataFrame, shared, bits: int, tokens: int, distinct: int, weight: float) -> DataFrame:
    """Scores by segments that stay beside their buckets."""
    chunks = cut(base.mapInArrow(_tokenised, _CHUNKS))
    asked = chunks.select("chunk", "sizes", "words", "back").mapInArrow(_asked(shared), _QUERY)
    levels = cut(asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(_probe(bits), _LEVELS))
    return chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_finish(shared, tokens, distinct, weight), _SCORED)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(h, "<u8").view("<i8")), pa.array(unpack(c, "<i8"))],
                                             ["word", "n"])


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT,
          most_bits: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    `held_out` is a boolean column over docs; rows where it is true (never null) are scored and not learnt from.
    Null and empty texts are the end mark alone. Repeated rows count as often as they come. With no training rows
    every count is 0 and the base is log10 1. Other columns of docs are not read. A filter of up to `most_bits` bits
    (MAX_BITS unless given) is broadcast; which way ran is logged, and the scores are the same.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    split = min(max(6, (size // BUCKET_BYTES).bit_length()), 24)
    gathered = base.where(~F.col("held_out")).select("text").mapInArrow(
        _gather(split), "bucket int, kind int, keys binary, counts binary")
    merged = cut(gathered.groupBy("bucket").applyInArrow(
        _merge, "bucket int, words binary, counts binary, pairs binary, levels binary, tokens long, distinct long, "
                "tally array<long>"))
    # A row per level, of which there are at most 64.
    tally = [r["n"] for r in merged.select(F.posexplode("tally").alias("level", "n")).groupBy("level")
             .agg(F.sum("n").alias("n")).orderBy("level").collect()] or [0]
    whole = merged.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = whole["tokens"] or 0, whole["distinct"] or 0
    wanted = sum((j + 1) * n for j, n in enumerate(tally)) * BITS_EACH
    bits = max(64, -(-wanted >> split) // 8 * 8 + 8)
    filled = merged.select("bucket", "words", "counts", "pairs", "levels").mapInArrow(
        _segments(bits), "bucket int, segment binary, words binary, counts binary")
    counted = merged.select("words", "counts").mapInArrow(_word_rows, "word long, n long")
    bar = tokens / HEAVY
    heavy = counted.where(F.col("n") >= bar).toArrow()
    h, c = heavy["word"].to_numpy().view(np.uint64), heavy["n"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    spread = wanted > (MAX_BITS if most_bits is None else most_bits)
    _LOG.info("filter of %d bits in %d segments, %s", wanted, 1 << split, "kept beside their buckets" if spread else "broadcast")
    if not spread:
        segments = np.zeros(bits // 8 << split, np.uint8)
        made = filled.select("bucket", "segment").toArrow()
        for bucket, segment in zip(made["bucket"].to_pylist(), made["segment"]):
            segments[bucket * bits // 8:(bucket + 1) * bits // 8] = np.frombuffer(segment.as_buffer(), np.uint8)
        shared = spark.sparkContext.broadcast((h, c, segments, bits, split))
        scored = cut(base.mapInArrow(_score(shared, tokens, distinct, weight), _SCORED))
    else:
        shared = spark.sparkContext.broadcast((h, c, split))
        scored = cut(_score_beside(base, filled, shared, bits, tokens, distinct, weight))
    joined = scored.drop("rare", "times")
    if spread:
        joined = joined.withColumns({"late_known": F.lit(0), "late_logs": F.lit(0.0)})
    else:
        pieces = scored.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
            "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        late = pieces.join(counted.where(F.col("n") < bar), "word").groupBy("row").agg(
            F.sum("times").alias("late_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("late_logs"))
        joined = joined.join(late, "row", "left")
    known = F.col("known") + F.coalesce("late_known", F.lit(0))
    base_score = F.col("logs") + F.coalesce("late_logs", F.lit(0.0)) - F.col("n_tokens") * float(
        np.log10(tokens + distinct + 1))
    return joined.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"),
                         F.lit(tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"),
                         (base_score + F.col("gain")).alias("score"))
