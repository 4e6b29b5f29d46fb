import json
import os

import pytest
from pyspark.sql import functions as F

from grovesift import cli
from grovesift.errors import NotReady, QueryError
from grovesift.functions import text
from grovesift.operators import forest, reconcile, rules
from grovesift.service import Engine
from grovesift.sources import fstree, sinks
from grovesift.sources.snapshots import SnapshotStore
from grovesift.streaming import changes, inspection

KINDS = "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean"


@pytest.fixture(scope="module")
def files(spark):
    rows = [(0, None, "/", 0, 0, True, 1, True), (1, 0, "a", 0, 1, True, 1, True), (2, 1, "x.txt", 5, 5, False, 1, True), (3, 1, "d", 0, 1, True, 1, True), (4, 3, "deep.md", 7, 7, False, 1, True), (5, 0, "b.md", 9, 9, False, 1, True)]
    return forest.build(spark.createDataFrame(rows, KINDS)).cache()


def test_rules():
    r = rules.ExcludeRules(names=("Private",), path_prefixes=("/tmp/x/",), exclude_hidden=True, file_patterns=("*.tmp", "Thumbs.db", ""))
    assert r.excludes(".h", "/.h", True) and r.excludes("Private", "/Private", False) and r.excludes("node_modules", "/n", False) and r.excludes(".git", "/.git", False)
    assert r.excludes("build", "/p/build", False, True) and not r.excludes("build", "/p/build", False) and r.excludes("y", "/tmp/x/y", False) and not r.excludes("xy", "/tmp/xy", False)
    assert r.excludes_file("A.TMP") and r.excludes_file("thumbs.DB") and not r.excludes_file("tmp")
    assert rules.ExcludeRules(names=("a", "b")).fingerprint() == rules.ExcludeRules(names=("b", "a")).fingerprint()
    assert rules.ExcludeRules(file_patterns=("a", "b")).fingerprint() != rules.ExcludeRules(file_patterns=("b", "a")).fingerprint()
    assert rules.ExcludeRules.from_json(r.to_json()) == r and rules.ExcludeRules.from_json("{}") == rules.ExcludeRules()


def test_scope(tmp_path):
    assert rules.outermost(["/b/", "/a", "/a/c", "/ab", "/System/Volumes/Data/a", "/tmp/q"]) == ("/a", "/ab", "/b", "/private/tmp/q")
    assert rules.IndexScope().roots == ("/",)
    s = os.stat(tmp_path)
    good = rules.IndexScope("folders", (str(tmp_path),), {})
    assert good.contains(f"{good.roots[0]}/x") and not good.contains(good.roots[0] + "x")
    assert rules.IndexScope("folders", ("/usr",), {"/usr": (s.st_dev, s.st_ino + 1)}).valid_roots() == ([], [("/usr", 2)])
    assert ("/net", False) in fstree.mounts("s /net nfs rw 0 0\nd / ext4 rw 0 0") and "/net" in rules.effective(rules.ExcludeRules(), [("/net", False)]).path_prefixes


def test_scan(spark, tmp_path):
    top = tmp_path / "t"
    for d in ("p/build", "p/src", "other/build", "kept.tmp"):
        (top / d).mkdir(parents=True)
    for f in ("p/Makefile", "p/build/x.o", "p/src/a.c", "other/build/y", "scratch.tmp", ".hidden", "kept.tmp/in"):
        (top / f).write_text("abc")
    (top / "loop").symlink_to(top)
    r = rules.ExcludeRules(path_prefixes=(), file_patterns=("*.tmp",))
    for parts in (1, 3, 64):
        got = fstree.scan(spark, [str(top)], r, parts)
        names = sorted(os.path.relpath(x.path, top) for x in got.collect())
        assert names == sorted([".", ".hidden", "kept.tmp", "kept.tmp/in", "loop", "other", "other/build", "other/build/y", "p", "p/Makefile", "p/src", "p/src/a.c"])
    built = forest.build(fstree.as_rows(got))
    assert sorted(x.path for x in built.collect()) == sorted(x.path for x in got.collect())
    assert built.filter(F.col("path") == str(top)).first().size == 0
    scope = rules.IndexScope("folders", (str(top / "p"), "/no/such"), {"/no/such": (1, 1)})
    if scope.contains(str(top / "p")):
        rows, lost = fstree.scan_scope(spark, scope, r, [("/", True)])
        counted, seen = fstree.with_progress(rows)
        assert counted.count() == 4 and seen.get == {"rows": 4, "errors": 0} and lost == [("/no/such", 2)]
    assert fstree.issues(fstree.scan(spark, [str(top / "missing")], r)).first().error_code == 2


def test_reconcile(files, spark):
    listed = spark.createDataFrame([(1, "x.txt", 6, 5, False), (1, "d", 0, 1, False), (1, "new", 1, 1, False)], "parent long, name string, size long, mtime long, is_dir boolean")
    diff = reconcile.diff(files, listed)
    assert {(r.name, r.action) for r in diff.collect()} == {("x.txt", "update"), ("d", "replace"), ("new", "insert")}
    emptied = reconcile.diff(files, listed.limit(0), spark.createDataFrame([(3,)], "parent long"))
    assert [(r.name, r.action) for r in emptied.collect()] == [("deep.md", "delete")]
    blank = files.withColumn("size", F.when(F.col("id") != 2, F.col("size")))
    assert {r.name: r.action for r in reconcile.diff(blank, listed).collect()}["x.txt"] == "update"
    after = {r.path: r for r in reconcile.apply(files, diff, 100).collect()}
    assert set(after) == {"/", "/a", "/a/x.txt", "/a/d", "/a/new", "/b.md"} and after["/a/x.txt"].size == 6 and not after["/a/d"].is_dir and after["/a/new"].id >= 100
    assert [r.name for r in reconcile.stale(files.filter("parent = 1"), listed.filter("name <> 'd'")).collect()] == ["d"]
    assert {r.id for r in reconcile.below(F.col("path"), spark.createDataFrame([("/a",)], "path string"), files, itself=False).collect()} == {2, 3, 4}
    fresh = reconcile.refresh(files, spark.createDataFrame([("/b.md", 1, 2, False), ("/a", 5, 5, False)], "path string, size long, mtime long, is_dir boolean"))
    assert {r.id: r.size for r in fresh.collect()}[5] == 1 and {r.id: r.mtime for r in fresh.collect()}[1] == 1


def test_snapshots(files, spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.load() is None and Engine(spark, store).status()["ready"] is False
    store.save(files.withColumn("is_live", F.col("id") != 5), "f1", 7, [("/x", 13)] * 200)
    loaded, m = store.load()
    assert loaded.count() == 5 and m.last_event_id == 7 and len(m.issues) == 100
    assert store.open_or_build("f1", None)[1].revision == 1
    _, m = store.open_or_build("f2", lambda: (files, [], 9))
    assert m.revision == 2 and m.last_event_id == 9
    store.save(files, "f2")
    store.drop_old(1)
    assert store.load()[0].count() == 6 and len([p for p in os.listdir(f"{tmp_path}/s") if p.startswith("v-")]) == 1
    newest = sorted((tmp_path / "s").glob("manifest-*.json"))[-1]
    revision = store.manifest().revision
    (tmp_path / f"s/manifest-{int(newest.name[9:-5]) + 1:012d}.json").write_text("{cut")  # a writer that died half-way
    assert store.manifest().revision == revision
    store.invalidate()
    assert store.load() is None


def test_a_writer_that_dies_between_its_steps_loses_nothing(files, spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.save(files, "f", 3)
    monkeypatch.setattr(SnapshotStore, "_publish", lambda self, now: (_ for _ in ()).throw(OSError("killed")))
    changed = files.filter("id = 5").withColumn("is_live", F.lit(False))
    for step in (lambda: store.save(files.limit(1), "f", 9), lambda: store.append(changed, 9)):
        with pytest.raises(OSError):
            step()
        assert store.load()[0].count() == 6 and store.manifest().last_event_id == 3
    monkeypatch.undo()
    other = SnapshotStore(spark, store.root)
    monkeypatch.setattr(SnapshotStore, "_numbers", lambda self, n=store._numbers(): n)  # two writers that saw the same manifests
    other.append(changed, 4)
    with pytest.raises(RuntimeError):
        store.append(changed, 5)
    monkeypatch.undo()
    assert store.manifest().last_event_id == 4 and store.load()[0].count() == 5


def test_changes_lie_over_the_base(files, spark, tmp_path, monkeypatch):
    from grovesift.sources import snapshots

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.save(files, "f", 1)
    row = lambda k, **new: files.filter(f"id = {k}").withColumns({c: F.lit(v) for c, v in new.items()})
    store.append(row(5, size=90), 2)
    store.append(row(5, size=91).unionByName(row(4, is_live=False)), 3)
    store.append(files.limit(0), 4)
    now, m = store.load()
    assert {r.id: r.size for r in now.collect()} == {0: 0, 1: 0, 2: 5, 3: 0, 5: 91} and len(m.changes) == 2 and m.last_event_id == 4 and not store.maintain()
    bases = [p for p in os.listdir(f"{tmp_path}/s") if p.startswith("v-")]
    assert len(bases) == 1  # changes cost their own size
    monkeypatch.setattr(snapshots, "MOST_CHANGES", 2)
    assert store.maintain() and store.manifest().changes == [] and store.load()[0].count() == 5 and store.manifest().last_event_id == 4
    assert store.maintain(compact=True) and sorted(r.id for r in store.load()[0].collect()) == [0, 1, 2, 3, 4]
    twice = files.withColumn("path", F.when(F.col("id") == 5, "/System/Volumes/Data").otherwise(F.col("path")))
    store.save(twice, "f")
    assert snapshots.contaminated(store.load()[0]) and store.open_or_build("f", lambda: (files, [], 9))[1].last_event_id == 9


def test_engine_and_command(files, spark, tmp_path, capsys):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    engine = Engine(spark, store)
    with pytest.raises(NotReady):
        engine.search("x")
    assert cli.run(["--store", "s", "x"], engine) == 3
    store.save(files, "f")
    assert [r["id"] for r in engine.search("ext:md", session="a")["results"]] == [5, 4] and engine.status()["count"] == 6
    with pytest.raises(QueryError):
        engine.search("x", limit=0)
    from grovesift.operators.search import Request

    assert [r["id"] for r in engine.resorted(Request("ext:md"), "size", True)["results"]] == [4, 5]
    capsys.readouterr()
    assert cli.run(["--store", "s", "--null", "ext:md"], engine) == 0 and capsys.readouterr().out == "/b.md\0/a/d/deep.md\0"
    assert cli.run(["--store", "s", "--format", "json", "b.md"], engine) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["schemaVersion"] == 1 and told["results"][0]["path"] == "/b.md" and told["results"][0]["modified"] == "1970-01-01T00:00:09Z"
    assert cli.run(["--store", "s", "--limit", "0", "x"], engine) == 2 and cli.run(["--store", "s", "AND"], engine) == 2
    engine.revoke()
    assert cli.run(["--store", "s", "x"], engine) == 3


def test_sinks(files, tmp_path, spark):
    sinks.write_tsv(files, f"{tmp_path}/tsv")
    lines = {r.value for r in spark.read.text([f"{tmp_path}/tsv/0-header", f"{tmp_path}/tsv/1-rows"]).collect()}
    assert "Name\tPath\tSize\tKind\tDate Modified" in lines and "b.md\t/b.md\t9\tMD File\t1970-01-01 00:00:09" in lines
    sinks.write_paths(files, f"{tmp_path}/p")
    assert spark.read.text(f"{tmp_path}/p").count() == 6


def test_routing(spark):
    kinds = "path string, event_id long, must_scan boolean, structural boolean, metadata boolean, mount boolean, dropped boolean"
    no = [False] * 5
    with_ = lambda *on: [k in on for k in range(5)]
    rows = [("/r/a", 1, *with_(1, 2)), ("/r/b", 2, *with_(0, 1)), ("/q", 3, *with_(1)), ("/r/c", 4, *no), ("/r/a", 5, *with_(2)), ("/r", 6, *with_(1)), ("/z", 7, *with_(4)), ("/q", 8, *with_(3))]
    routed = changes.route(spark.createDataFrame(rows, kinds), ["/r"])
    assert {tuple(r) for r in routed.collect()} == {
        (1, "/r", "list", False), (1, "/r/a", "refresh", False), (2, "/r/b", "list", True), (4, "/r/c", "list", False), (5, "/r/a", "refresh", False), (6, "/", "rebuild", False), (7, "/", "rebuild", False),
    }
    assert changes.coalesced(routed).count() == 5
    failed = spark.createDataFrame([("/r", k) for k in range(8)], "path string, attempt int")
    assert [r.delay for r in changes.retries(failed).orderBy("attempt").collect()] == [1, 2, 4, 8, 16, 32, 60, 60]
    assert changes.cursor(3, routed, True) == 3 and changes.cursor(3, routed, False) == 7
    flags = spark.createDataFrame([(0x100 | 0x400,), (0x40,), (0x2,), (0x1,)], "f int")
    got = [tuple(r) for r in flags.select(*changes.classify(F.col("f")).values()).collect()]
    assert got == [(False, False, False, True, True), (False, False, True, False, False), (False, True, False, False, False), (True, False, False, False, False)]


EVENTS = changes.EVENTS


def event(path, number, *kinds):
    return (path, number, *(k in kinds for k in ("must_scan", "structural", "metadata", "mount", "dropped")))


@pytest.fixture
def disk(spark, tmp_path):
    """A folder on disk, its store, and a live table over both."""
    top = tmp_path / "top"
    for d in ("kept/inner", "full"):
        (top / d).mkdir(parents=True)
    for f in ("kept/a.txt", "kept/inner/b.txt", "full/only.txt", "root.txt"):
        (top / f).write_text("abc")
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rules_ = rules.ExcludeRules(path_prefixes=(), file_patterns=("*.tmp",))
    build = lambda: forest.build(fstree.as_rows(fstree.scan(spark, [str(top)], rules_)))
    store.save(build(), "f", 1)
    told = []
    live = changes.LiveTable(store, "f", [str(top)], inspection.inspector(rules_, [("/", True)]), build, [told.append])
    send = lambda *events: live.apply(spark.createDataFrame([event(f"{top}/{e[0]}".rstrip("/"), *e[1:]) for e in events], EVENTS))
    paths = lambda: {os.path.relpath(r.path, top): r for r in store.load()[0].filter("is_live").collect()}
    return top, store, live, send, paths, told


def on_disk(top):
    return {os.path.relpath(os.path.join(d, n), top) for d, ds, fs in os.walk(top) for n in [*ds, *fs]} | {"."}


def test_feed_follows_what_happens_on_disk(disk):
    import shutil

    top, store, live, send, paths, told = disk
    assert set(paths()) == on_disk(top)
    (top / "full/only.txt").unlink()  # the last child of a folder
    (top / "kept/a.txt").write_text("longer text")
    (top / "new/deep/er").mkdir(parents=True)  # a folder with all below it
    (top / "new/deep/er/x.txt").write_text("x")
    (top / "new/skipped.tmp").write_text("x")
    send(("full/only.txt", 2, "structural"), ("kept/a.txt", 3, "metadata"), ("new/deep", 4, "structural"), ("new", 5, "structural"))
    (top / "new/skipped.tmp").unlink()
    now = paths()
    assert set(now) == on_disk(top) - {"new/skipped.tmp"} and now["kept/a.txt"].size == 11 and store.manifest().last_event_id == 5 and told[-1].revision == 2
    assert len({r.id for r in now.values()}) == len(now) and now["new/deep/er/x.txt"].depth == 4 and now["new/deep/er/x.txt"].parent == now["new/deep/er"].id
    shutil.rmtree(top / "new")
    (top / "new").write_text("a file now")
    (top / "kept/inner/b.txt").unlink()
    (top / "kept/inner/c.txt").write_text("c")
    send(("new", 6, "structural"), ("kept", 7, "must_scan"))
    assert set(paths()) == on_disk(top) and not paths()["new"].is_dir
    shutil.rmtree(top / "kept/inner")
    send(("kept/inner/c.txt", 8, "structural"))  # the folder itself is gone: its children go, its row waits for its parent
    assert set(paths()) == on_disk(top) | {"kept/inner"}
    send(("kept/inner", 9, "structural"))
    assert set(paths()) == on_disk(top) and len([p for p in os.listdir(store.root.removeprefix("file://")) if p.startswith("v-")]) == 1
    live.deny([f"{top}/full"])
    assert "full" not in paths()


def test_feed_keeps_what_it_cannot_read(disk, spark):
    import errno

    top, store, live, send, paths, _ = disk
    inspect, broken = live.inspect, [True]

    def faulty(tasks, files, gate=None):
        seen = inspect(tasks, files, gate)
        lost = (F.col("path") == f"{top}/kept") & F.lit(broken[0])
        return seen.filter(~((F.col("kind") == "child") & (F.col("name") == "a.txt") & F.lit(broken[0]))).withColumn("error", F.when(lost & (F.col("kind") == "folder"), errno.EACCES).otherwise(F.col("error")))

    faulty.subtrees = inspect.subtrees
    now = [1000.0]
    live.inspect, live.clock = faulty, lambda: now[0]
    (top / "kept/more.txt").write_text("m")
    send(("kept/more.txt", 5, "structural"), ("root.txt", 6, "metadata"))
    assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 1 and live.next_retry() == 1  # added, nothing removed, no event left behind
    now[0] += 1
    send(("root.txt", 7, "metadata"))  # the path is due
    assert live.next_retry() == 2
    broken[0] = False
    send(("root.txt", 8, "metadata"))  # it isn't
    assert live.next_retry() == 2 and store.manifest().last_event_id == 1
    again = changes.LiveTable(SnapshotStore(spark, store.root), "f", [str(top)], inspect, live.rebuild, clock=lambda: now[0])  # another driver takes over
    now[0] += 1.9
    assert not again.tick()
    now[0] += 0.2
    again.apply(spark.createDataFrame([event(f"{top}/root.txt", 8, "metadata")], EVENTS))
    assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 8 and again.next_retry() is None


def test_a_table_follows_a_log(disk, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "canonical_column", lambda path: path)  # /tmp has another name there
    top, store, live, _, paths, _ = disk
    (tmp_path / "log").mkdir()

    def put(number, *paths_):
        lines = [json.dumps({"path": f"{top}/{p}", "event_id": number + k, "flags": 0x100}) for k, p in enumerate(paths_)]
        (tmp_path / "log/.part").write_text("\n".join(lines) + "\n")
        os.replace(tmp_path / "log/.part", tmp_path / f"log/{number:06d}.json")

    (top / "kept/s.txt").write_text("s")
    put(1, "root.txt", "kept/s.txt")  # the first of them is in the store already
    q = live.follow(str(tmp_path / "log"), f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
        assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 2
    finally:
        q.stop()
    (top / "full/only.txt").unlink()
    put(3, "full/only.txt")
    q = live.follow(str(tmp_path / "log"), f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
        assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 3
    finally:
        q.stop()


def test_retries_wait_for_their_time_and_need_no_event(disk, spark, tmp_path):
    import time

    top, store, live, send, paths, _ = disk
    now, looked, inspect = [5000.0], [], live.inspect
    live.clock = lambda: now[0]

    def watched(tasks, files, gate=None):
        looked.append(sorted(r.path for r in tasks.collect()))
        return inspect(tasks, files, gate)

    watched.subtrees = inspect.subtrees
    live.inspect = watched
    waiting = spark.createDataFrame([(f"{top}/kept", 3, now[0] + text.retry_delay(3)), (f"{top}/full", 9, now[0] + text.retry_delay(9))], "path string, attempt int, due double")
    store.append(store.load()[0].limit(0), 1, None, waiting)
    (top / "kept/late.txt").write_text("l")
    for step, seen in ((0, 0), (3.9, 0), (0.1, 1), (0.5, 1), (55.0, 1), (0.6, 2)):
        now[0] += step
        live.tick()
        assert len(looked) == seen, step
        send(("root.txt", 9, "metadata")) if step == 3.9 else None
        looked = [x for x in looked if x != [f"{top}/root.txt"]]
    assert looked == [[f"{top}/kept"], [f"{top}/full"]] and set(paths()) == on_disk(top) and live.next_retry() is None
    live.clock, live.MAINTENANCE = time.time, 0.0  # and by a stream of its own, without any event
    store.append(store.load()[0].limit(0), 9, None, spark.createDataFrame([(f"{top}/kept", 1, time.time())], "path string, attempt int, due double"))
    q = live.start_ticking(f"{tmp_path}/ticks")
    try:
        for _ in range(600):
            if live.next_retry() is None:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert live.next_retry() is None and looked[-1] == [f"{top}/kept"]


def test_maintenance_by_the_clock(disk, spark):
    top, store, live, send, paths, _ = disk
    now = [0.0]
    live.clock, live.maintained = lambda: now[0], 0.0
    for k in range(3):
        store.append(store.load()[0].filter("not is_dir").withColumn("size", F.lit(k).cast("long")), k)
    import grovesift.sources.snapshots as module

    before, base = store.load()[0], store.manifest().folder
    assert store.manifest().changed_rows == 12
    kept, module.FEW_CHANGED = module.FEW_CHANGED, 5
    try:
        now[0] = 59.0
        assert not live.tick() and len(store.manifest().changes) == 3
        now[0] = 60.0
        assert live.tick() and store.manifest().changes == [] and store.manifest().changed_rows == 0 and {r.size for r in paths().values() if not r.is_dir} == {2}
        folders = lambda: set(os.listdir(store.root.removeprefix("file://")))
        now[0] = 659.0
        live.tick()
        assert base in folders() and before.count() == 8  # a search that began before goes on
        now[0] = 720.0
        live.tick()
        assert base not in folders() and len(paths()) == 8
    finally:
        module.FEW_CHANGED = kept


def test_folders_that_have_not_changed_are_not_listed(disk, spark):
    top, store, live, send, paths, _ = disk
    tasks = spark.createDataFrame([(f"{top}/kept", "list", False)], "path string, task string, deep boolean")
    send(("kept/a.txt", 2, "structural"))
    assert live.gate.count() == 1 and live.inspect(tasks, store.load()[0], live.gate).count() == 0 and live.inspect(tasks, store.load()[0], None).count() == 3
    assert live.inspect(tasks.withColumn("deep", F.lit(True)), store.load()[0], live.gate).filter("kind = 'folder'").count() == 2
    (top / "kept/z.txt").write_text("z")
    send(("kept/z.txt", 3, "structural"))
    assert "kept/z.txt" in paths()
    far = inspection.inspector(rules.ExcludeRules(), [("/", True), (str(top), False)])
    assert [(r.kind, r.error) for r in far(tasks, store.load()[0]).collect()] == [("folder", 95)]
    send(("kept", 4, "mount"))  # a whole new scan
    assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 4


def test_stream_goes_on_from_the_last_event(disk, spark, tmp_path):
    top, store, live, _, paths, _ = disk
    (tmp_path / "in").mkdir()
    put = lambda *rows: spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    (top / "kept/s.txt").write_text("s")
    put(event(f"{top}/kept/s.txt", 5, "structural"))
    q = live.start(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
        assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 5
    finally:
        q.stop()
    (top / "full/t.txt").write_text("t")
    put(event(f"{top}/full/t.txt", 6, "structural"))
    q = live.start(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp2")  # without its checkpoint: old events are left out
    try:
        q.processAllAvailable()
        assert set(paths()) == on_disk(top) and store.manifest().last_event_id == 6
    finally:
        q.stop()


def test_events_from_a_monitor_s_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = [{"path": "/a/b", "event_id": 3, "flags": 0x100}, {"path": "/System/Volumes/Data/c", "event_id": 4, "flags": 0x400}, {"path": "/d", "event_id": 5, "flags": 0x2}]
    (tmp_path / "log/1.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    q = changes.read_flags(spark, f"{tmp_path}/log", after=3).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert got == [("/c", 4, False, False, True, False, False), ("/d", 5, False, False, False, False, True)]


def test_subtree_below_a_row_that_is_there(spark, tmp_path):
    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/f").write_text("x")
    rows = {r.name: r for r in fstree.as_rows(fstree.scan(spark, [str(tmp_path / "t")]), 500, under=7, vol_id=3).collect()}
    assert set(rows) == {"d", "f"} and rows["d"].parent == 7 and rows["f"].parent == rows["d"].id >= 500 and rows["f"].vol_id == 3


def test_volume_roots_and_system_volumes():
    from grovesift.functions.text import is_volume_root

    assert is_volume_root("/") and is_volume_root("/Volumes/usb") and is_volume_root("/System/Volumes/Data") and not is_volume_root("/Volumes/usb/x") and not is_volume_root("/home")
    assert rules.effective(rules.ExcludeRules(), []).excludes("VM", "/System/Volumes/VM", False) and not rules.ExcludeRules().excludes("VM", "/System/Volumes/VM", False)


def test_settings_scans_and_cancelling(files, spark, tmp_path):
    import threading
    import time

    from grovesift.errors import Busy, Cancelled, code_of

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    engine = Engine(spark, store)
    assert engine.settings() == (rules.ExcludeRules(), rules.IndexScope())
    asked = []
    scope, own = rules.IndexScope("folders", ("/a",), {"/a": (1, 2)}), rules.ExcludeRules(names=("x",))
    engine.configure(own, scope, lambda r, s: (asked.append((r, s)), (files, [], 4))[1])
    assert asked == [(own, scope)] and Engine(spark, store).settings() == (own, scope) and store.manifest().fingerprint == scope.fingerprint(own)
    engine.configure(own, scope, None)  # the same: nothing is scanned
    engine.configure(own, rules.IndexScope(), lambda r, s: (files.limit(2), [], 5))
    assert store.load()[0].count() == 2 and engine.ping(60)
    scans, go = [], threading.Event()

    def slow():
        scans.append(1)
        go.wait(60)
        return files, [], 6

    threads = [threading.Thread(target=engine.rebuild, args=("f", slow)) for _ in range(5)]
    threads[0].start()
    while not scans:
        time.sleep(0.01)
    for t in threads[1:]:
        t.start()
    while engine.asked < engine.served + 5:
        time.sleep(0.01)
    go.set()
    for t in threads:
        t.join()
    assert len(scans) == 2  # the one that ran, and one for all that came meanwhile

    def cancel_at_once(tag, work, pool, run=engine._run):
        engine.cancel(tag)
        return run(tag, work, pool)

    engine._run = cancel_at_once
    with pytest.raises(Cancelled) as e:
        engine.search("x")
    assert code_of(e.value) == "cancelled" and code_of(KeyError()) == "internalError" and code_of(Busy()) == "overloaded" and not engine.cancelled and not engine.active


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['grovesift.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'text_ci' in e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_nested_roots_of_whole_levels(spark):
    from grovesift import queries

    folder = "/root/testdata/sf0.001"
    paths = {r.path for r in queries.files(spark, folder).filter("depth >= 3").select("path").collect()}
    outer = sorted(p for p in paths if not any(p[:i] in paths for i, c in enumerate(p) if c == "/"))
    got = sorted(r.path for r in queries.QUERIES["nested_root_elim_whole"](spark, folder).collect())
    assert got == outer and 0 < len(outer) < len(paths)
