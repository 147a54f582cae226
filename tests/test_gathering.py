"""One-pass gathering of what belongs to a key, references, and event logs with holes."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import checks, execution, ingest


def test_references_are_checked_in_one_pass(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    b = spark.createDataFrame([("x",)], "name string")
    child = spark.createDataFrame([(1, "x", 1), (3, "y", None), (3, None, 9), (None, "y", 2)], "a_id long, b_name string, other int")
    found = checks.orphans({"a": (a, "id"), "b": (b, "name")}, [(child, "a_id", "a"), (child, "b_name", "b"), (child, "other", "a")])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("3", "a_id refers to a", "2"), ("9", "other refers to a", "1"), ("y", "b_name refers to b", "2")]
    assert checks.orphans({"a": (a.where("false"), "id")}, [(child.where("false"), "a_id", "a")]).count() == 0
    nothing = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "a int, b int")
    assert [r.row_key for r in checks.repeated(nothing, ["a", "b"], "unique").collect()] == ["2|5"]


def test_parts_of_a_key_meet_in_one_shuffle(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "z")], "k long, x string")
    right = spark.createDataFrame([(2, 5), (3, 6), (3, 7)], "k long, y int")
    every = spark.createDataFrame([(3, 1), (3, 1), (3, 2)], "k long, w int")
    got = {r.k: r for r in ingest.gathered("k", {"left": left, "right": right, "every": every}, lists=("every",)).collect()}
    assert {k: (r.left and r.left.x, r.right and r.right.y, sorted(x.w for x in r.every)) for k, r in got.items()} == {
        1: ("a", None, []), 2: ("a", 5, []), 3: (None, 6, [1, 1, 2])}


EVENTS = "plan_id long, seq long, event string, strategy string, step string"


def test_illegal_events_with_nulls_are_rejected(spark):
    plans = spark.createDataFrame([(1, "APPROVED"), (2, "BLOCKED")], "plan_id long, status string")
    log = [(1, 1, "START"), (2, None, "START"), (7, None, "START"), (1, None, "SUCCEED"), (1, 2, None), (None, 3, None)]
    events = spark.createDataFrame([(*e, None, None) for e in log], EVENTS)
    current, rejects = execution.fold_events(plans, events)
    assert {r.plan_id: r.status for r in current.collect()} == {1: "EXECUTING", 2: "BLOCKED"}
    assert sorted((r.plan_id or 0, r.seq or 0, r.event or "", r.reject_reason) for r in rejects.collect()) == [
        (0, 3, "", "no such plan"), (1, 0, "SUCCEED", "no seq or event"), (1, 2, "", "no seq or event"),
        (2, 0, "START", "no seq or event"), (7, 0, "START", "no such plan")]


@pytest.mark.parametrize("with_listing", [False, True])
def test_destinations_are_looked_up_without_moving_rows(spark, with_listing):
    """Holders, folders that are files, rivals, and names whose parts could be mistaken for each other."""
    plans = spark.createDataFrame([
        (1, 10, "READY", "/d", "a"), (2, 20, "READY", "/d", "a"), (3, 10, "READY", "/d", "b/c"), (4, 30, "READY", "/d/b", "c"),
        (5, 50, "SUPERSEDED", "/d", "x"), (6, 60, "READY", "/d", "x"), (7, 70, "READY", None, None), (8, 80, "READY", "/f", "y")],
        "plan_id long, media_file_id long, status string, destination_directory string, destination_filename string")
    plans = plans.withColumns({"destination_path": F.concat_ws("/", "destination_directory", "destination_filename"), "absolute_path": F.lit("/in")})
    plans = plans.withColumn("destination_path", F.when(F.col("destination_filename").isNotNull(), F.col("destination_path")))
    files = spark.createDataFrame([("/d/x", "ACTIVE"), ("/f", "MISSING"), (None, "ACTIVE")], "absolute_path string, state string")
    listing = spark.createDataFrame([("/f",)], "absolute_path string") if with_listing else None
    got = {r.plan_id: list(r.collisions) for r in ingest.with_collisions(plans, files, plans, listing, by="plan_id").collect()}
    rival = "another active plan (#%d) targets the same destination"
    held, there = "destination path already exists in canonical inventory", "destination path already exists on disk: /d/x"
    taken = [held] if with_listing else [there, held]
    occupied = ["destination directory path is occupied by a file: /f"] if with_listing else []
    assert got == {1: [rival % 2], 2: [rival % 1], 3: [], 4: [], 5: [*taken, rival % 6], 6: taken, 7: [], 8: occupied}
