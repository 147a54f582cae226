"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists; what is left after the list's centre is coded by subspace. A query's
distances to the codes of a list are sums of table entries (asymmetric distances). Two vectors of cosine t lie
r = sqrt(2 - 2t) apart, which makes the search whole rather than approximate: a list can hold a partner only if the
plane halfway between its centre and the query's own is at most r away, and a partner's asymmetric distance is at
most r plus its own coding error, which is stored with the code. All lists and codes within those bounds are kept
and reranked by the exact cosine in double precision. Of two vectors the one of the lower list looks for the
other, and both count what it finds; inside a list, members look for members. There are as many lists as the label
with the most vectors fills with LIST_ROWS each.

Vectors of unequal length don't link, so each length that occurs has an index of its own. Its centres and codebooks
are fitted on SAMPLE vectors of the length at most (the least hashes); every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import components, cut

SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
LIST_ROWS = 2_000
MAX_LISTS = 4096
BLOCK = 2_000
NUMBERS = 1 << 23
SLACK = 1e-6


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres ** 2).sum(1) / 2
    for lo in range(0, len(x), 4096):
        out[lo:lo + 4096] = (x[lo:lo + 4096] @ centres.T - half).argmax(1)
    return out


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from rows spread over the sample; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _model(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and, per subspace, the codebook of the residuals."""
    centres = _means(sample, lists)
    rest = sample - centres[_nearest(sample, centres)]
    width = -(-rest.shape[1] // SUBSPACES)
    rest = np.pad(rest, ((0, 0), (0, width * SUBSPACES - rest.shape[1])))
    books = [_means(rest[:, i * width:(i + 1) * width], min(CODES, len(rest))) for i in range(SUBSPACES)]
    return centres, np.stack(books)


def _encode(x: np.ndarray, own: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = books.shape[2]
    rest = np.pad(x - centres[own], ((0, 0), (0, width * SUBSPACES - x.shape[1])))
    codes = np.stack([_nearest(rest[:, i * width:(i + 1) * width], b) for i, b in enumerate(books)], 1)
    coded = np.concatenate([books[i][codes[:, i]] for i in range(SUBSPACES)], 1)
    return codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(1))


def _matrix(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


_FILED = "class long, label string, length int, copies long, list int, role int, unit binary, codes binary, error double"


def _file(shared, r: float):
    """A row for a vector's own list (role 1, with codes) and one for each higher list it has to probe (role 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        between = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                if length not in between:
                    centres = models[length][0]
                    between[length] = np.stack([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
                own, model = batch.take(pa.array(np.flatnonzero(lengths == length))), models[length]
                step = max(64, NUMBERS // len(model[0]))
                for lo in range(0, own.num_rows, step):
                    yield filed(own.slice(lo, step), *model, between[length])

    def filed(batch, centres, books, between):
        x = _matrix(batch.column("unit"))
        own = _nearest(x, centres)
        codes, error = _encode(x, own, centres, books)
        away = 1 + (centres ** 2).sum(1) - 2 * x @ centres.T
        over = away - away[np.arange(len(x)), own][:, None]
        higher = np.arange(len(centres)) > own[:, None]
        who, where = np.nonzero(higher & (over <= 2 * (r + SLACK) * between[own] + SLACK))
        everyone = np.r_[np.arange(len(x)), who]
        role = np.r_[np.ones(len(x), np.int32), np.zeros(len(who), np.int32)]
        rows = batch.select(["class", "label", "length", "copies", "unit"]).take(pa.array(everyone))
        return pa.RecordBatch.from_arrays([
            *rows.columns[:4], pa.array(np.r_[own, where].astype(np.int32)), pa.array(role), rows.column(4),
            pa.array([codes[i].tobytes() if k else None for i, k in zip(everyone, role)], pa.binary()),
            pa.array(np.where(role == 1, error[everyone], 0.0)),
        ], ["class", "label", "length", "copies", "list", "role", "unit", "codes", "error"])
    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _search(shared, threshold: float, r: float):
    """One block of a list's members against queries of one turn, and against itself where block and turn are the same:
    how many copies each vector links with, and links enough to hang together everything that is linked here."""
    def run(part: pa.Table) -> pa.Table:
        centres, books = shared.value[part["length"][0].as_py()]
        queries, members = part.filter(pc.equal(part["role"], 0)), part.filter(pc.equal(part["role"], 1))
        out_class, out_count, edge_a, edge_b = [], [], [], []
        if members.num_rows:
            centre = centres[part["list"][0].as_py()]
            m, mid, weight = _matrix(members["unit"]), members["class"].to_numpy(), members["copies"].to_numpy()
            codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(mid), SUBSPACES)
            reach = (r + members["error"].to_numpy() + SLACK) ** 2
            width = books.shape[2]
            ids = np.unique(np.r_[queries["class"].to_numpy(), mid])
            mat, parent = np.searchsorted(ids, mid), np.arange(len(ids))
            sides = [(m, mid, weight, False)] if part["block"][0].as_py() == part["turn"][0].as_py() else []
            if queries.num_rows:
                sides.append((_matrix(queries["unit"]), queries["class"].to_numpy(), queries["copies"].to_numpy(), True))
            for q, qid, own_weight, mutual in sides:
                qat, back = np.searchsorted(ids, qid), np.zeros(len(mid))
                for lo in range(0, len(q), 256):
                    block = q[lo:lo + 256]
                    rest = np.pad(block - centre, ((0, 0), (0, width * SUBSPACES - q.shape[1])))
                    far = np.zeros((len(block), len(mid)))
                    for i, book in enumerate(books):
                        own = rest[:, i * width:(i + 1) * width]
                        far += ((own ** 2).sum(1)[:, None] + (book ** 2).sum(1) - 2 * own @ book.T)[:, codes[:, i]]
                    who, where = np.nonzero(far <= reach)
                    cosine = np.einsum("ij,ij->i", block[who], m[where])
                    good = (cosine >= threshold) & (qid[lo + who] != mid[where])
                    who, where = who[good] + lo, where[good]
                    out_class.append(qid[lo:lo + 256])
                    out_count.append(np.bincount(who - lo, weight[where], len(block)).astype(np.int64))
                    if mutual:
                        back += np.bincount(where, own_weight[who], len(mid))
                    # Links between what already hangs together add nothing.
                    while len(who):
                        a, b = parent[qat[who]], parent[mat[where]]
                        open_ = a != b
                        who, where, a, b = who[open_], where[open_], a[open_], b[open_]
                        if not len(who):
                            break
                        up, down = np.maximum(a, b), np.minimum(a, b)
                        first = np.unique(up, return_index=True)[1]
                        edge_a.append(qid[who[first]])
                        edge_b.append(mid[where[first]])
                        parent[up[first]] = down[first]
                        parent = _roots(parent)
                out_class.append(mid)
                out_count.append(back.astype(np.int64))
        join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        classes, counts, a, b = map(join, (out_class, out_count, edge_a, edge_b))
        some = counts > 0
        classes, counts = classes[some], counts[some]
        nothing = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(classes, pa.int64()), pa.array(a, pa.int64())]),
            "b": pa.concat_arrays([nothing(len(classes)), pa.array(b, pa.int64())]),
            "n": pa.concat_arrays([pa.array(counts, pa.int64()), nothing(len(a))])})
    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at unit length; those that are null, empty, zero or hold a null or non-finite component go."""
    for batch in batches:
        kept, units = [], []
        for i, v in enumerate(batch.column("vector")):
            v = v.as_py()
            if not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
                continue
            x /= top
            kept.append(i)
            units.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column("row").take(pa.array(kept, pa.int64())), batch.column("label").take(pa.array(kept, pa.int64())),
            pa.array(units, pa.binary())], ["row", "label", "unit"])


def _models(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A model for each length of unit vectors (in bytes, eight a component) that occurs. The bounds hold with any
    model, so a length with few vectors has one list, round the origin, and isn't read for a fit."""
    models = {}
    sizes = classes.groupBy("length", "label").agg(F.count("*").alias("n")).groupBy("length").agg(F.sum("n"), F.max("n"))
    for length, n, most in sizes.orderBy("length").collect():
        size = length // 8
        if n < CODES:
            models[length] = np.zeros((1, size)), np.zeros((SUBSPACES, 1, -(-size // SUBSPACES)))
            continue
        share = min(1.0, 1.2 * SAMPLE / n)
        chosen = classes.where((F.col("length") == length) & (F.pmod(F.xxhash64("print"), F.lit(1 << 20)) <= int(share * (1 << 20))))
        drawn = chosen.orderBy("print").limit(SAMPLE).select("unit").toArrow()["unit"].to_pylist()
        sample = np.stack([np.frombuffer(x, "<f8") for x in drawn])
        models[length] = _model(sample, int(np.clip(most // LIST_ROWS, 1, min(MAX_LISTS, len(sample)))))
    return models


def link(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of rows.

    Vectors link when their labels are equal and not null and their cosine reaches the threshold. A vector that is
    null, empty, zero or holds null or non-finite components links with nothing, nor do vectors of different
    lengths. Ids are taken as unique: rows of one id and one vector are copies of each other and count as such. A
    null id links with nothing. Other columns are not read.

    Equal unit vectors of a label form one class, searched once and counted as often as it occurs. A list that many
    share is searched in blocks of BLOCK members and BLOCK queries; only counts and a spanning set of links leave a
    block.
    """
    spark = rows.sparkSession
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    base = rows.select(F.col(id_col).cast("long").alias("row"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vector"))
    units = base.where("label IS NOT NULL AND row IS NOT NULL").mapInArrow(_units, "row long, label string, unit binary")
    units = cut(units.withColumn("print", F.md5("unit")))
    keys = ["label", "print"]
    classes = cut(units.groupBy(*keys).agg(F.min("row").alias("class"), F.count("*").alias("copies"),
                                           F.first("unit").alias("unit")))
    lone = base.select(F.col("row").alias("vec_id"))
    n = classes.count()
    if not n:
        return lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    classes = classes.withColumn("length", F.length("unit"))
    shared = spark.sparkContext.broadcast(_models(classes))
    filed = cut(classes.select("class", "label", "length", "copies", "unit").mapInArrow(_file(shared, r), _FILED))
    place = ["label", "length", "list"]
    load = filed.where("role = 1").groupBy(*place).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A member stands in its block for every turn of queries. A query of another list meets every block; a member is
    # a query of its own list too, and meets the blocks before its own.
    placed = filed.join(load, place)
    held = placed.where("role = 1").withColumn("block", own).withColumn("turn", every)
    probes = placed.where("role = 0").withColumn("turn", own).withColumn("block", every)
    inside = placed.where("role = 1 AND blocks > 1").withColumn("role", F.lit(0)).withColumn("turn", own).withColumn(
        "block", every).where("block < turn")
    sent = ["class", *place, "copies", "role", "unit", "codes", "error", "block", "turn"]
    both = held.select(*sent).union(probes.select(*sent)).union(inside.select(*sent))
    found = cut(both.groupBy(*place, "block", "turn").applyInArrow(
        _search(shared, threshold, r), "a long, b long, n long"))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    reached = components(found.where("b IS NOT NULL").select("a", "b").distinct())
    named = classes.select(*keys, "class", "copies").join(counts, "class", "left").join(
        reached, F.col("class") == F.col("node"), "left").select(
        *keys, F.coalesce("component", "class").alias("of"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = units.join(named, keys).groupBy(F.col("row").alias("vec_id")).agg(
        F.max("links").alias("links"), F.min("of").alias("of"))
    out = lone.join(linked, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("of", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("of", "vec_id"), F.lit(True)).alias("kept"))
