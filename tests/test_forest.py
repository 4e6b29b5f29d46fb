"""Paths of forests of any depth, and the rows that reach no root."""

import os

from grovesift import scratch
from grovesift.operators import forest

KINDS = "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, p, n, 1, 1, True, 1, True) for i, p, n in rows], KINDS)


def test_depth_has_no_bound(spark):
    rows = [(0, None, "/"), *((i, i - 1, f"d{i % 7}") for i in range(1, 1200))]
    got = {r.id: r for r in forest.build(table(spark, rows)).select("id", "path", "depth").collect()}
    assert len(got) == 1200 and got[1199].depth == 1199
    assert got[1199].path == "/" + "/".join(f"d{i % 7}" for i in range(1, 1200))


def test_orphans_and_cycles_are_issues(spark):
    rows = [(0, None, "/"), (1, 0, "a"), (2, 1, "b"), (10, 99, "orphan"), (11, 10, "below"), (12, 11, "further"), (20, 22, "x"), (21, 20, "y"), (22, 21, "z"), (23, 22, "tail"), (24, 23, "tail"), (30, 30, "itself")]
    files, issues = forest.placed(table(spark, rows))
    assert {r.id: r.path for r in files.collect()} == {0: "/", 1: "/a", 2: "/a/b"}
    assert {r.id: r.problem for r in issues.collect()} == {10: "orphan", 11: "orphan", 12: "orphan", **dict.fromkeys((20, 21, 22, 23, 24, 30), "cycle")}


def test_rounds_leave_one_table(spark):
    place = scratch.folder(spark).removeprefix("file://") + "/tables"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    rows = [(0, None, "/"), *((i, i - 1, "d") for i in range(1, 200))]
    assert forest.build(table(spark, rows)).count() == 200
    assert len({n for n in os.listdir(place) if n.startswith("paths-")} - before) == 1


def test_empty_forest(spark):
    files, issues = forest.placed(table(spark, []))
    assert files.collect() == [] and issues.collect() == []
