"""Data skipping, the stored index and claims of versions."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from grovesift.operators import forest
from grovesift.operators.search import Request, matches
from grovesift.service import Engine
from grovesift.sources.snapshots import SnapshotStore, spans
from grovesift.streaming import changes


def tree(spark, folders, each):
    """``folders`` folders below /a and /b with ``each`` files, whose names are a word and their number."""
    i = F.col("id")
    dirs = spark.range(folders).select((i + 3).alias("id"), F.when(i % 2 == 0, 1).otherwise(2).cast("long").alias("parent"), F.format_string("d%06d", i).alias("name"), F.lit(0).alias("size"), F.lit(True).alias("is_dir"))
    dirs = dirs.withColumn("path", F.concat(F.when(F.col("parent") == 1, "/a/").otherwise("/b/"), "name"))
    files = dirs.select(F.col("id").alias("parent"), F.col("path").alias("front"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    word = F.when(F.pmod(F.hash("parent", "k"), F.lit(997)) == 0, F.lit("Zebra")).otherwise("common")
    files = files.select((F.col("parent") * each + F.col("k") + 10_000_000).alias("id"), "parent", F.concat(word, F.lit("-"), F.col("parent").cast("string"), F.lit("."), F.col("k").cast("string")).alias("name"), F.col("k").alias("size"), F.lit(False).alias("is_dir"), "front")
    files = files.withColumn("path", F.concat("front", F.lit("/"), "name")).drop("front")
    tops = spark.createDataFrame([(0, None, "/", 0, True, "/"), (1, 0, "a", 0, True, "/a"), (2, 0, "b", 0, True, "/b")], "id long, parent long, name string, size int, is_dir boolean, path string")
    rows = tops.unionByName(dirs).unionByName(files)
    depth = F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1)
    rows = rows.withColumns({"size": F.col("size").cast("long"), "mtime": F.lit(1).cast("long"), "depth": depth.cast("int"), "vol_id": F.lit(1), "is_live": F.lit(True)})
    return forest.with_folds(rows).select(*forest.SCHEMA.fieldNames())


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """10^6 rows in at least 100 files, with an index."""
    store = SnapshotStore(spark, f"file://{tmp_path_factory.mktemp('big')}/s", rows_per_file=8_000, indexed=True)
    store.save(tree(spark, 1000, 1000), "f", 1)
    return store


def test_spans_hold_what_they_say():
    rng = random.Random(3)
    names = ["a", "a-b", "a0", "a/b", "a b", "é", "A"]
    paths = sorted({"/" + "/".join(rng.choice(names[:3] + names[4:]) for _ in range(rng.randrange(1, 4))) for _ in range(300)} | {"/"})
    key = lambda p: (p.rpartition("/")[0], p)
    for p in paths[:60]:
        within = lambda q, what: any(low <= key(q) <= high for low, high in spans(p, what))  # noqa: B023, E731
        top = "" if p == "/" else p
        assert all(within(q, "row") == (q == p) for q in paths)
        assert all(within(q, "children") for q in paths if q != "/" and q.rpartition("/")[0] == top)
        assert all(within(q, "subtree") for q in paths if q == p or q.startswith(top + "/"))
        assert not any(within(q, "subtree") for q in paths if q != p and not q.startswith(top + "/") and q != "/" and q.rpartition("/")[0] != top)


def test_a_batch_reads_the_files_that_it_touches(big, spark):
    files = len(big._ranges(big.manifest().folder))
    asked = spark.createDataFrame([(f"/a/d{k:06d}", w) for k in (2, 4, 6) for w in ("row", "children")] + [("/b/d000101/common-104.7", "row"), ("/", "row"), ("/", "children")], "path string, what string")
    near = big.near(asked)
    assert files > 100 and len(near.inputFiles()) <= 0.05 * files
    assert near.filter("path like '/a/d000004/%'").count() == 1000 and near.filter("path in ('/', '/a', '/b', '/a/d000006', '/b/d000101/common-104.7')").count() == 5
    assert big.near(spark.createDataFrame([("/a", "subtree")], "path string, what string")).filter("path like '/a/%'").count() == 500 * 1001


def test_events_over_many_rows(big, spark, monkeypatch):
    """Ten events: the store is read in some files only, and what is published is right."""
    touched, lookup = [], SnapshotStore.touched
    monkeypatch.setattr(SnapshotStore, "touched", lambda self, m, asked: touched.append(lookup(self, m, asked)) or touched[-1])
    monkeypatch.setattr(SnapshotStore, "_whole", lambda *_: pytest.fail("the whole table was read"))
    gone = {f"/b/d{k:06d}" for k in range(1, 11, 2)}

    def inspect(tasks, files, gate=None):
        """/b lists all its folders but some; a folder of /a lists one more file; one item is larger."""
        rows = [("folder", None, None, "/b", None, None, 1, None, None), ("folder", None, None, "/a/d000002", None, None, 1, None, None), ("item", None, None, "/a/d000004/common-7.1", 77, 1, None, False, None)]
        kind = "kind string, parent_path string, name string, path string, size long, mtime long, mtime_ns long, is_dir boolean, error int"
        seen = spark.createDataFrame([*rows, ("child", "/a/d000002", "new", "/a/d000002/new", 5, 5, None, False, None)], kind)
        kept = files.filter("is_live and ((parent = 2 and is_dir) or parent = 5)").filter(~F.col("path").isin(*gone))
        front = F.regexp_replace("path", "/[^/]*$", "")
        return seen.unionByName(kept.select(F.lit("child").alias("kind"), front.alias("parent_path"), "name", "path", "size", "mtime", F.lit(None).cast("long").alias("mtime_ns"), "is_dir", F.lit(None).cast("int").alias("error")))

    before = big.manifest()
    live = changes.LiveTable(big, "f", ["/"], inspect, None)
    events = [("/b/d000001", 2, "structural"), ("/b/d000009", 3, "structural"), ("/a/d000002/new", 4, "structural"), ("/a/d000004/common-7.1", 5, "metadata"), *((f"/b/d{k:06d}", 6 + k, "structural") for k in (1, 3, 5, 7, 9, 9))]
    live.apply(spark.createDataFrame([(p, n, *(k == what for k in ("must_scan", "structural", "metadata", "mount", "dropped"))) for p, n, what in events], changes.EVENTS))
    files, now = len(big._ranges(before.folder)), big.manifest()
    assert len(touched[0]) <= 0.05 * files and all(len(t) <= 0.1 * files for t in touched)
    monkeypatch.undo()
    rows = big.load()[0]
    assert now.live == before.live - 5 * 1001 + 1 == rows.count() and now.bytes == before.bytes - 5 * 999 * 500 + 5 + 76 == rows.agg(F.sum("size")).first()[0]
    assert rows.filter("path like '/b/d000003%'").isEmpty() and rows.filter("path = '/a/d000002/new' and size = 5 and id > 11000000").count() == 1
    assert Engine(spark, big).status()["count"] == now.live


@pytest.mark.parametrize(
    ("text", "options", "indexed"),
    [("zebra-77", {}, True), ("common", {}, False), ("common-77", {}, True), ("regex:zebra-(11|22)0*\\.", {}, True), ('regex:"zebra-100[0-3]\\.|zebra-99\\."', {}, True), ("zebra-3 OR zebra-4", {}, None), ("zebra NOT zebra-5", {}, None), ("NOT zebra", {}, False),
     ("ZEBRA-77*", {"ignore_case": False}, True), ("Zebra-77", {"ignore_case": False}, True), ("nothing-like-this", {}, True), ("zebra-77", {"match_path": True}, False), ("new", {}, True), ("in:/a zebra size:>900", {}, None)],
)
def test_searches_take_the_index_or_scan(big, text, options, indexed):
    request = Request(text, **options)
    m, whole = big.manifest(), big.load()[0]
    table = big.searchable(request.plan.tree, request.options)
    read, every = (sum(f"/{m.folder}/" in f for f in t.inputFiles()) for t in (table, whole))
    assert indexed in (None, read < every)  # None: every file holds a match, or the bound is about the share
    assert {r.id for r in matches(table, request).select("id").collect()} == {r.id for r in matches(whole, request).select("id").collect()}


def test_two_writers_claim_one_number(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    for n in range(200):
        won, go = [], threading.Barrier(2)

        def claim(k):
            go.wait()
            won.append((store._put(store._path(n), str(k)), k))  # noqa: B023

        threads = [threading.Thread(target=claim, args=(k,)) for k in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sorted(w for w, _ in won) == [False, True] and store._read(store._path(n)) == str(next(k for w, k in won if w))


def test_half_written_manifests_are_passed_over(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", indexed=True)
    store.save(tree(spark, 2, 2), "f", 1)
    assert store._put(store._path(2), '{"folder": "v-')
    assert store.manifest().last_event_id == 1
    store.append(store.load()[0].limit(0), 2)
    assert store.manifest().last_event_id == 2 and store._numbers()[0] == 3
    store.save(tree(spark, 1, 0), "f", 3)  # few rows, no name of three characters but one
    assert store.searchable(Request("d0000").plan.tree, Request("d0000").options).filter("name like 'd%'").count() == 1
    store.save(tree(spark, 1, 1).limit(0), "f", 4)
    assert store.load()[0].count() == 0 and store.searchable(Request("abcd").plan.tree, Request("abcd").options).count() == 0
