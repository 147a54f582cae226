"""A Merkle manifest of a table: one tree of digests per group, one over the groups, and every row's proof.

Rows are leaves; their rank in the group, written in base FAN, names their place in the tree. Blocks of
FAN ** DIGITS leaves are rolled up by grouping the rank's digits away one after another, children nested in their
parent as an array of structs, so a block is one row that holds its whole subtree. A block's digest is a leaf of the
next layer of blocks, and so on to the root. On the way down each block meets the path above it once (a union and one
grouping, no join) and is exploded digit by digit, which hands every leaf its path.

DataFrame operations only. No step sorts or collects a group: ranks come from a range partitioning over the whole
table and the sizes of its partitions, and a block is bounded whatever the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import beside, cut

FAN, DIGITS = 8, 3
BLOCK = FAN ** DIGITS
_PART_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits and the position in them


def _digest(hashed: Column) -> Column:
    return F.unhex(F.sha2(hashed, 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _run_digest(run: Column) -> Column:
    return _digest(F.array_join(F.transform(run, _text), ""))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over the fields one after another, each `-` if null, else its UTF-8 byte count, `:` and its text."""
    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return _digest(F.concat(*map(told, fields)))


def _ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with `rank` (from 0) inside their tree by `order`, and `n`, the tree's number of nodes.

    All rows are sorted by ranges of (tree, order); a row's position in its partition is shifted by what the
    partitions before it hold of the tree. The row's place in the input breaks ties, so equal rows are spread too.
    """
    keys = ["tree", *order, "tie"]
    spread = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    laid = cut(spread.sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftrightunsigned("at", _PART_BITS))
    held = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("held").over(tree).alias("n"))
    found = laid.join(beside(held, F.octet_length("tree") + 24), ["tree", "part"])
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _many(layer: int) -> Column:
    """Whether more than one node of the tree is left that many layers above the nodes counted by n."""
    return F.col("n") > FAN ** layer


def _rolled(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, digest, kids) per block of nodes (tree, n, rank, digest, item). One shuffle by block; the
    groupings by ever fewer digits keep its partitioning."""
    digits = [F.expr(f"rank DIV {FAN ** i} % {FAN}").cast("int").alias(f"d{i}") for i in range(DIGITS)]
    block = F.expr(f"rank DIV {BLOCK}").alias("block")
    rows = nodes.select("tree", "n", block, *digits, "digest", "item").repartition("tree", "block")
    rows = rows.withColumn("kid", F.struct(F.col("d0").alias("digit"), "digest", "item"))
    for layer in range(DIGITS):
        keys = ["tree", "n", "block", *[f"d{i}" for i in range(layer + 1, DIGITS)]]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        run = F.transform("kids", lambda k: k["digest"])
        rows = rows.withColumn("digest", F.when(_many(layer), _run_digest(run)).otherwise(F.col("kids")[0]["digest"]))
        if layer + 1 < DIGITS:
            rows = rows.withColumn("kid", F.struct(F.col(f"d{layer + 1}").alias("digit"), "digest", "kids"))
    return rows.select("tree", "n", "block", "digest", "kids")


def _layers(nodes: DataFrame, first: int) -> list[DataFrame]:
    """The blocks of nodes, the blocks over those, and so on until every tree has one; `first` numbers the layers."""
    out = []
    while True:
        blocks = cut(_rolled(nodes))
        out.append(blocks)
        if not blocks.where(F.col("n") > BLOCK).limit(1).count():
            return out
        item = F.struct(F.lit(first + len(out) - 1).alias("layer"), "tree", "block")
        nodes = blocks.where(F.col("n") > BLOCK).select(
            "tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("rank"), "digest",
            item.alias("item"))


_STEP = "struct<at:int,run:array<binary>>"


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(item, digest, subroot, root, path) per node under the blocks. above: (tree, block, subroot, root, path) for
    each of the blocks; path: the runs of digests from a node's own up to the root's, and the node's place in each."""
    held = F.struct("n", "kids")
    known = F.struct("subroot", "root", "path")
    rows = blocks.select("tree", "block", held.alias("held"), F.lit(None).cast(
        "struct<subroot:binary,root:binary,path:array<" + _STEP + ">>").alias("known"))
    above = above.select("tree", "block", F.lit(None).cast(rows.schema["held"].dataType).alias("held"), known.alias("known"))
    met = rows.union(above).groupBy("tree", "block").agg(
        F.first("held", ignorenulls=True).alias("held"), F.first("known", ignorenulls=True).alias("known"))
    rows = met.select("held.n", "held.kids", "known.subroot", "known.root", "known.path")
    for layer in reversed(range(DIGITS)):
        run = F.transform("kids", lambda k: k["digest"])
        rows = rows.select("n", "subroot", "root", "path", run.alias("run"), F.explode("kids").alias("kid"))
        step = F.struct(F.col("kid.digit").alias("at"), "run").cast(_STEP)
        path = F.when(_many(layer), F.concat(F.array(step), "path")).otherwise(F.col("path"))
        last = ["kid.item", "kid.digest"] if layer == 0 else ["kid.kids"]
        rows = rows.select("n", "subroot", "root", path.alias("path"), *last)
    return rows.drop("n")


def _proof(path: Column) -> Column:
    others = F.flatten(F.transform(path, lambda s: F.filter(s["run"], lambda _, i: i != s["at"])))
    return F.sha2(F.array_join(F.transform(others, _text), ""), 256)


def _folded(path: Column, start: Column) -> Column:
    def up(own: Column, step: Column) -> Column:
        return _run_digest(F.transform(step["run"], lambda x, i: F.when(i == step["at"], own).otherwise(x)))
    return F.aggregate(path, start, up)


def manifest(docs: DataFrame, altered: Column, altered_text: Column, id_col: str = "doc_id", group_col: str = "lang",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs, digests as lowercase hex.

    A group's leaves ascend by id (null first), rows of one id by their digest; every FAN consecutive nodes become
    the digest of theirs until one is left, the group's subroot. The subroots, by group (null first, then bytewise),
    give the root likewise. proof_sha256 covers a row's siblings from leaf to root. folded_root is computed from
    those siblings and, where `altered` is true, from the leaf with `altered_text` for its text; it equals the root
    (verified) where nothing of the row changed.

    Null fields count as `-`, which no text gives; null ids and empty texts make leaves like any other. Rows that
    repeat each make a leaf of their own. An empty table gives no rows, a table of one row is its own root and its
    proof the digest of nothing. Other columns are not read.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    bent = leaf_digest([altered_text if c == text_col else F.col(c) for c in fields])
    group = F.col(group_col).cast("string")
    leaves = cut(docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), F.col(id_col).alias("id"),
        leaf.alias("digest"), F.when(altered, bent).alias("bent")))
    ranked = _ranked(leaves, ["id", "digest"]).select(
        "tree", "n", "rank", "digest", F.struct("id", "bent").alias("item"))
    groups = _layers(ranked, 0)
    tops = [b.where(F.col("n") <= BLOCK).select(
        F.lit("").alias("tree"), F.col("tree").alias("named"), "digest",
        F.struct(F.lit(i).alias("layer"), "tree", "block").alias("item")) for i, b in enumerate(groups)]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.union(more)
    forest = _layers(_ranked(cut(subroots), ["named"]).drop("named"), len(groups))
    top = forest[-1].select("tree", "block", F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"),
                            F.array().cast(f"array<{_STEP}>").alias("path"))
    for blocks in reversed(forest[1:]):
        top = _down(blocks, top).select("item.tree", "item.block", "subroot", "root", "path")
    below = _down(forest[0], top).select("item.*", F.col("digest").alias("subroot"), "root", "path")
    above = below.where(F.col("layer") == len(groups) - 1).drop("layer")
    for i in reversed(range(1, len(groups))):
        known = _down(groups[i], above).select("item.tree", "item.block", "subroot", "root", "path")
        above = known.union(below.where(F.col("layer") == i - 1).drop("layer"))
    rows = _down(groups[0], above)
    start = F.coalesce("item.bent", "digest")
    found = rows.select(F.col("item.id").alias("doc_id"), _text(F.col("digest")).alias("leaf"),
                        _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"),
                        _proof(F.col("path")).alias("proof_sha256"), _text(_folded(F.col("path"), start)).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
