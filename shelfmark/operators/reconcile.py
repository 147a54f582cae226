"""Keyed reconcile of stored state with an incoming set: one full outer join per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new row of each key side by side as structs (null where a side has none)."""
    left = old.select(*key, F.struct(*old.columns).alias("old"))
    right = new.select(*key, F.struct(*new.columns).alias("new"))
    return left.join(right, key, "full_outer")


def same(fields: list[str], a: str = "old", b: str = "new") -> Column:
    """All fields equal, null equal to null."""
    result = F.lit(True)
    for field in fields:
        result = result & F.col(f"{a}.{field}").eqNullSafe(F.col(f"{b}.{field}"))
    return result


def field_changes(fields: list[str], old: str = "old", new: str = "new") -> Column:
    """Array of (field, old, new) for the fields that differ, in the order given.

    Values are compared as they are and rendered as text only then, since fields differ in type.
    """
    def change(field):
        before, after = F.col(f"{old}.{field}"), F.col(f"{new}.{field}")
        return F.when(~before.eqNullSafe(after), F.struct(
            F.lit(field).alias("field"), before.cast("string").alias("old"), after.cast("string").alias("new")))

    return F.array_compact(F.array(*[change(f) for f in fields]))


def outcome_counts(df: DataFrame, outcomes: list[str], column: str = "outcome") -> DataFrame:
    """One row with a counter per outcome."""
    return df.agg(*[F.count_if(F.col(column) == o).cast("long").alias(o.lower()) for o in outcomes])


def surrogate_key(*natural: Column) -> Column:
    """Key for a new row. Stored from then on and never recomputed."""
    return F.xxhash64(*natural)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row; a write should find none."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def latest(df: DataFrame, key: list[str], order: list[str], prefer: list[Column] | None = None) -> DataFrame:
    """The last row per key by ``order``; combines map-side, so hot keys stay small."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *(prefer or []))
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def join_key(df: DataFrame, key: str, spread: str | None = None) -> Column:
    """A nullable text key for an outer join: nulls become row-specific texts that match nothing.

    Null keys all hash to one partition, which many rows without a value would overload. The
    text derives from the row itself (from its column ``spread``, where one is named), so a task that runs again
    makes the same one.
    """
    hashable = [spread] if spread else [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.xxhash64(*hashable).cast("string")))


def next_time(df: DataFrame, key: str, at: str, tie: str, out: str) -> DataFrame:
    """Add ``out``: the time of the key's next row by (``at``, ``tie``), null for its last.

    Rows are ordered within a key and day; the last of a day takes the first of the key's next
    day. A key with very many rows is thus ordered a day at a time, not in one task.
    """
    day = F.date_trunc("day", F.col(at))
    df = df.withColumn("__day", day)
    firsts = df.groupBy(key, "__day").agg(F.min(at).alias("__first")).withColumn(
        "__next_day", F.lead("__first").over(Window.partitionBy(key).orderBy("__day"))).drop("__first")
    inside = F.lead(at).over(Window.partitionBy(key, "__day").orderBy(at, tie))
    return (
        df.withColumn("__inside", inside).join(firsts, [key, "__day"])
        .withColumn(out, F.coalesce("__inside", "__next_day")).drop("__day", "__inside", "__next_day"))


def scd2(open_rows: DataFrame, incoming: DataFrame, key: list[str], compare: list[str], run_ts: Column,
         closed_status: str, new_id: Column) -> DataFrame:
    """Open rows against incoming ones: keep when equal, else close the old and open a new.

    Returns every row to hold from now on, with ``outcome`` KEPT, CLOSED or OPENED. Incoming
    rows carry the business columns; ``new_id`` builds their key.
    """
    both = pair(open_rows, incoming, key)
    business = [c for c in incoming.columns]
    unchanged = F.col("new").isNull() | (F.col("old").isNotNull() & same(compare))
    kept = F.when(F.col("old").isNotNull(), F.struct(
        *[F.when(~unchanged, closed_status).otherwise(F.col("old.status")).alias(c) if c == "status"
          else F.when(~unchanged, run_ts).otherwise(F.col("old.updated_at")).alias(c) if c == "updated_at"
          else F.col(f"old.{c}").alias(c) for c in open_rows.columns],
        F.when(unchanged, "KEPT").otherwise("CLOSED").alias("outcome")))
    made = {"id": new_id, "status": F.lit("ACTIVE"), "created_at": run_ts, "updated_at": run_ts}
    types = {f.name: f.dataType for f in open_rows.schema.fields}
    opened = F.when(~unchanged, F.struct(
        *[(made[c] if c in made else F.col(f"new.{c}") if c in business else F.lit(None)).cast(types[c]).alias(c)
          for c in open_rows.columns],
        F.lit("OPENED").alias("outcome")))
    return both.select(F.inline(F.array_compact(F.array(kept, opened))))


def apply_decisions(state: DataFrame, decisions: DataFrame, key: list[str], invalid: Column, keep: str = "last",
                    repeated: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Check every decision against the state, then let one valid decision per key count.

    ``decisions`` carries ``decided_at`` and ``decision_id`` for order. ``invalid`` gives the reason text over the
    structs ``state`` (null when the key is unknown) and ``decision``, or null when it may be applied. ``keep`` is
    ``last`` where a later decision replaces an earlier one, ``first`` where the first settles the matter; with
    ``repeated`` the valid ones after the first are rejects for that reason. Decisions without a key or a time are
    rejects as well. Returns (pairs, rejects); pairs hold every state row with its decision, if any.
    """
    order = F.struct("decision.decided_at", "decision.decision_id")
    given = F.lit(True)
    for k in key:
        given = given & F.col(k).isNotNull()
    untimed = decisions.where(F.col("decided_at").isNull() | ~given).select("*", F.lit("no key or time").alias("reject_reason"))
    current = state.select(*key, F.struct(*state.columns).alias("state"))
    timed = decisions.where(F.col("decided_at").isNotNull() & given).select(*key, F.struct(*decisions.columns).alias("decision"))
    checked = timed.join(current, key, "left").withColumn("reject_reason", invalid)
    rejects = checked.where(F.col("reject_reason").isNotNull()).select("decision.*", "reject_reason")
    valid = checked.where(F.col("reject_reason").isNull()).select(*key, "decision")
    pick = F.min_by if keep == "first" else F.max_by
    chosen = valid.groupBy(*key).agg(pick("decision", order).alias("chosen"))
    if repeated is not None:
        late = valid.join(chosen, key).where(F.col("decision.decision_id") != F.col("chosen.decision_id"))
        rejects = rejects.unionByName(late.select("decision.*", repeated.alias("reject_reason")))
    pairs = current.join(chosen, key, "left").select("state", F.col("chosen").alias("decision"))
    return pairs, rejects.unionByName(untimed)
