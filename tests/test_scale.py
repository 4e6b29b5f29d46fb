"""Steps whose tasks must not grow with the table: no key that most rows share, and no partition of any size."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from grovesift import queries
from grovesift.operators import below, forest, rules, trigrams
from grovesift.operators.search import Request, matches, matches_of
from grovesift.sources import snapshots
from grovesift.sources.snapshots import SnapshotStore

KINDS = "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mounts_go_to_the_paths(spark):
    """no exchange by mount, of which ``/`` has all paths, and no table of all paths to group them."""
    paths = spark.createDataFrame([(p, k) for k, p in enumerate(["/", "/a", "/a/b", "/a/b", "/ab", "/a/b/c/d", "rel/a", "", None, "/z"])], "path string, k long")
    mounts = spark.createDataFrame([("/a", True), ("/a/b", False), ("/a/b", False), ("/a/b/c/d", None), (None, True), ("rel", True)], "mount string, is_local boolean")
    got = rules.inspectable(paths, mounts)
    assert got.columns == ["path", "k", "local"] and "hashpartitioning(path" not in plan(got) and "Join [mount" not in plan(got)
    assert {r.k for r in got.collect() if r.local} == {1} and got.count() == 10 and got.filter("local is null").isEmpty()
    top = rules.inspectable(paths, spark.createDataFrame([("/", True), ("/a", False)], "mount string, is_local boolean"))
    assert {r.k for r in top.collect() if r.local} == {0, 4, 9}
    assert rules.inspectable(paths, mounts.limit(0)).filter("local").isEmpty()


def expected(rows, folders, itself):
    below = lambda p, f: p.startswith(f + "/") if f != "/" else p.startswith("/") and p != "/"
    return sorted(k for p, k in rows if p is None or not any(below(p, f) or (itself and p == f) for f in folders))


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("folders", [[], ["/"], ["/a"], ["/a/b", "/c", "/c/d0", None], ["/a/b/f3", "/c/d5", "/c/d6/f6", "/d"]])
def test_rows_below_folders(spark, folders, itself):
    """Folders apart, with as few rows as five, and others; the same as by prefixes."""
    names = ["/", "/a", "/a/b", "/ab", "/c", "/x", None, *(f"/a/b/f{k}" for k in range(9)), *(f"/c/d{k}/f{k}" for k in range(9)), *(f"/c/d{k}" for k in range(9)), "/x/y/z", "/d/e/f/g", "/a/b/f3/x", "/a/b/f3"]
    rows = [(p, k) for k, p in enumerate(names)]
    table, cut = spark.createDataFrame(rows, "path string, k long"), spark.createDataFrame([(f,) for f in folders], "path string")
    for many in (5, 10**6):
        assert sorted(r.k for r in below.outside(table, cut, itself, many=many).collect()) == expected(rows, [f for f in folders if f], itself), many


@pytest.fixture
def largest(spark, monkeypatch):
    """The most rows of one key on the left of any join that isn't a broadcast one, as joins are made."""
    kind, seen = type(spark.range(1)), [0]
    join = kind.join

    def watched(self, other, on=None, how=None):
        if isinstance(on, str | list) or "_met" in self.columns:
            if "ResolvedHint" not in other._jdf.queryExecution().analyzed().toString():
                seen[0] = max(seen[0], self.groupBy("_met" if "_met" in self.columns else on).count().agg(F.max("count")).first()[0] or 0)
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", watched)
    monkeypatch.setattr(below, "MANY", 100, raising=False)
    return seen


def test_nested_roots_dont_meet_under_one_folder(spark, largest):
    """F5."""
    table = spark.range(3000).select(F.concat(F.lit("/r/s"), (F.col("id") % 40).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path")).unionByName(spark.createDataFrame([("/r/s7",)], "path string"))
    assert rules.outermost_rows(table).count() == 3001 - 75 and largest[0] <= 100


def test_rows_of_the_root_dont_meet(spark, largest):
    """a table whose rows all lie directly in ``/``."""
    table = spark.range(500).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("path"))
    assert rules.outermost_rows(table).count() == 500 and largest[0] <= 100
    assert rules.outermost_rows(table.unionByName(spark.createDataFrame([("/",)], "path string"))).collect() == [("/",)]


def test_entries_dont_meet_under_one_folder(spark, largest):
    """F6. A project's build folder takes what is below it away, also a row of its own path."""
    rows = [(k, k % 60, f"f{k}", f"/p/d{k % 60}/f{k}", False, False) for k in range(2400)]
    rows += [(3000, 7, "package.json", "/p/d7/package.json", False, False), (3001, 7, "build", "/p/d7/build", False, True), (3002, 9, "x", "/p/d7/build/x", False, False), (3003, 9, "y", "/p/d7/build", False, False), (3004, 9, "z", "/p/d7/builds", False, False)]
    got = rules.apply_rules(spark.createDataFrame(rows, "id long, parent long, name string, path string, hidden boolean, is_dir boolean"), rules.ExcludeRules())
    assert {r.id for r in got.collect()} == {r[0] for r in rows} - {3001, 3002, 3003} and largest[0] <= 100


def test_parents_dont_meet_in_one_task(spark, largest):
    """ancestors of very many rows go to the rows."""
    rows = [(0, None, "/"), (1, 0, "a"), *((k, 1 if k < 2000 else 999_999, f"f{k}") for k in range(2, 2500))]
    files, issues = forest.placed(spark.createDataFrame([(i, p, n, 1, 1, True, 1, True) for i, p, n in rows], KINDS))
    assert files.count() == 2000 and files.filter("id = 77").first().path == "/a/f77" and issues.count() == 500 and largest[0] <= 100


def test_partitions_by_bytes_of_paths(spark, monkeypatch):
    """long paths get more partitions, whatever they are compressed to."""
    monkeypatch.setattr(forest, "PART_BYTES", 100_000, raising=False)
    rows = [(i, None if i % 200 == 0 else i - 1, "/r" if i % 200 == 0 else "abcdefgh") for i in range(2000)]
    files = forest.build(spark.createDataFrame([(i, p, n, 1, 1, True, 1, True) for i, p, n in rows], KINDS))
    whole = files.agg(F.sum(F.length("path"))).first()[0]
    assert files.count() == 2000 and files.rdd.getNumPartitions() > whole / 100_000


def test_compaction_keeps_what_stands_where_something_was(spark, largest):
    """rows below a folder that is gone go; one that was made anew at the path of a deleted row stays."""
    rows = [(0, None, "/", "/", True), (1, 0, "a", "/a", True), (2, 0, "b", "/b", False), (3, 2, "x", "/b/x", True), (5, 1, "f1", "/a/f1", False), (9000, 1, "f1", "/a/f1", True), *((10 + k, 1, f"g{k}", f"/a/g{k}", True) for k in range(2000))]
    table = forest.with_folds(spark.createDataFrame([(i, p, n, q, 1, 1, 1, False, 1, on) for i, p, n, q, on in rows], "id long, parent long, name string, path string, depth int, size long, mtime long, is_dir boolean, vol_id int, is_live boolean"))
    got = forest.compacted(table).orderBy("id").collect()
    assert [r.id for r in got] == list(range(2003)) and {r.path for r in got} == {r[3] for r in rows} - {"/b", "/b/x"}
    assert got[-1].path == "/a/f1" and got[-1].parent == 1


def test_a_save_works_folders_out_once_a_row(spark, tmp_path, monkeypatch):
    """F8: the sort of a base compares columns, not expressions, and its postings are in no order within a run."""
    seen, write = [], SnapshotStore._write
    monkeypatch.setattr(SnapshotStore, "_write", lambda self, rows, kind: seen.append(plan(rows)) or write(self, rows, kind))
    rows = [(0, None, "/"), *((k, 0, f"x{k:04d}-0000") for k in range(1, 300)), (300, 0, "𝒳𝒳𝒳𝒳é.tx"), (301, 0, "ab"), (302, 0, "aaa"), (303, 0, "ababab")]
    store = SnapshotStore(spark, f"file://{tmp_path}/s", rows_per_file=50, indexed=True)
    m = store.save(forest.build(spark.createDataFrame([(i, p, n, 1, 1, p is None, 1, True) for i, p, n in rows], KINDS)), "f")
    sorts = [line for line in seen[0].splitlines() if "Sort [" in line or "rangepartitioning(" in line]
    assert sorts and not any("regexp_replace" in line.partition("Sort [")[2] + line.partition("rangepartitioning(")[2] for line in sorts)
    postings = trigrams._postings(spark, f"{store.root}/{m.index}").join(store._numbered(m.folder), "number")
    held = {(r.file, r.id) for r in store._base(m.folder).select("id", F.col("_metadata.file_name").alias("file")).collect()}
    got = [(r.gram, r.id, r.file) for r in postings.collect()]
    files = {i: f for f, i in held}
    assert sorted(got) == sorted((g, i, files[i]) for i, _, n in rows for g in {n.lower()[k : k + 3] for k in range(len(n) - 2)}) and len(set(files.values())) > 5


def test_a_base_is_listed_once(spark, tmp_path):
    """F8: searches, loads and scans of a version don't list its files again."""
    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    store = SnapshotStore(spark, f"file://{tmp_path}/s", rows_per_file=5)
    m = store.save(forest.build(spark.createDataFrame([(0, None, "/", 1, 1, True, 1, True), *((k, 0, f"n{k}", 1, 1, False, 1, True) for k in range(1, 400))], KINDS)), "f")
    before = found.getCount()
    for _ in range(4):
        request = Request("path:n7")
        assert store.load()[0].count() == 400 and matches(store.searchable(request.plan.tree, request.options), request).count() == 11
    assert found.getCount() - before < 80
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/{m.folder}")
    assert place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True) and store.load() is None


def test_files_that_most_matches_name_are_scanned(spark, tmp_path, monkeypatch):
    """F8: a rare run that lies in most files isn't a list of all their names."""
    monkeypatch.setattr(snapshots, "FEW_FILES", 10, raising=False)
    store = SnapshotStore(spark, f"file://{tmp_path}/s", rows_per_file=100, indexed=True)
    names = [f"n{k:05d}" + (".rare" if k % 90 == 0 else ".lone" if k < 40 else "") for k in range(1, 4000)]
    m = store.save(forest.build(spark.createDataFrame([(0, None, "/", 1, 1, True, 1, True), *((k, 0, n, 1, 1, False, 1, True) for k, n in enumerate(names, 1))], KINDS)), "f")
    every, kept = len(store._ranges(m.folder)), spark.conf.get(snapshots.LISTING_TASKS)
    for text, some in (("rare", False), ("lone", True), ("nothing", True)):
        request = Request(text)
        table = store.searchable(request.plan.tree, request.options)
        assert every > 30 and (len(table.inputFiles()) < every / 2) == some
        assert matches(table, request).count() == sum(text in n for n in names)
    assert spark.conf.get(snapshots.LISTING_TASKS) == kept


def test_requests_share_a_scan(spark):
    files = forest.build(spark.createDataFrame([(0, None, "/", 1, 1, True, 1, True), *((k, 0, f"n{k}", k, 1, False, 1, k % 7 > 0) for k in range(1, 200))], KINDS))
    requests = [Request(t) for t in ("n1", "size:>150b", "regex:^n.$", "n1 OR n2", "absent")]
    got = matches_of(files, requests)
    assert sorted((r.term, r.id) for r in got.select("term", "id").collect()) == sorted((q.text, r.id) for q in requests for r in matches(files, q).collect())


@pytest.mark.parametrize(("share", "few"), [(0.02, 1_000), (0.5, 1)])
def test_terms_tell_whether_they_were_scanned_for(spark, tmp_path, monkeypatch, share, few):
    """index_or_scan tells of every term what was done for it: the index while its runs are rare, however many files have them."""
    monkeypatch.setattr(snapshots, "INDEX_SHARE", share)
    monkeypatch.setattr(snapshots, "FEW_FILES", few)
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"), "nation": ([(k, f"NATION_{k}", k % 2) for k in range(12)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"Customer#{k:09d}", k % 12) for k in range(1, 201)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(k, k % 200 + 1, "O", 1.5, datetime(1995, 1, 1)) for k in (1, 77, 120, 215, *range(7700, 7720), *range(40_000, 43_000))], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
    }
    base = duckdb.connect()
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    names = [r.name_fold for r in queries.files(spark, str(tmp_path)).select("name_fold").collect()]
    rarest = lambda t: min(sum(t[k : k + 3] in n for n in names) for k in range(len(t) - 2))
    bounds = [*(rarest(t.lower()) for t in queries._TERMS[:4]), rarest("order-12") + rarest("order-21") + min(rarest("nat"), rarest("on_9")), len(names)]
    got = queries.QUERIES["index_or_scan"](spark, str(tmp_path)).collect()
    assert {(r.term, r.scanned) for r in got} == {(t, n > share * len(names)) for t, n in zip(queries._TERMS, bounds, strict=True)}
    assert share > 0.02 or sum(n > share * len(names) for n in bounds[:5]) == 1, "CUSTOMER#00000001"
    want = base.execute(queries.SQL["index_or_scan"].replace("0.02", str(share))).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_many_files_are_taken_from_the_listing(spark, tmp_path, monkeypatch):
    """files that the index names are read alone, also where they are too many to be looked up one by one."""
    monkeypatch.setattr(snapshots, "FEW_FILES", 3)
    store = SnapshotStore(spark, f"file://{tmp_path}/s", rows_per_file=100, indexed=True)
    m = store.save(forest.build(spark.createDataFrame([(0, None, "/", 1, 1, True, 1, True), *((k, 0, f"n{k:05d}", 1, 1, False, 1, True) for k in range(1, 2000))], KINDS)), "f")
    counts = {r.file: r["rows"] for r in store._ranges_table(m.folder).select("file", "rows").collect()}
    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    some, before = sorted(counts)[::3], found.getCount()
    rows = store.rows_of(m, some).select("id")
    assert len(rows.collect()) == sum(counts[n] for n in some) < 2000 and found.getCount() == before
    assert rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value() == len(some) > 3
