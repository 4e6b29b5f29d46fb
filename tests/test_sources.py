"""The event log as a stream with offsets, scans by frontier, order by collation."""

import json
import os

from pyspark.sql import functions as F

from grovesift.operators.search import Request, search
from grovesift.operators import forest
from grovesift.operators.rules import ExcludeRules
from grovesift.sources import changelog, fstree


def put(folder, *ids, junk=False):
    """A file of events, as a monitor adds it."""
    os.makedirs(folder, exist_ok=True)
    lines = [json.dumps({"path": f"/p/{i}", "event_id": i, "flags": i % 7}) for i in ids]
    with open(f"{folder}/.part", "w") as f:
        f.write("\n".join([*lines[:1], *(["not an event", '{"path": "/x"}'] if junk else []), *lines[1:]]) + "\n")
    os.replace(f"{folder}/.part", f"{folder}/{min(ids):09d}.json")


def test_a_stream_loses_and_repeats_no_event(spark, tmp_path):
    log, out, kept = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/kept"
    put(log, *range(1, 40), junk=True)
    put(log, 40, 41)

    def run(since=-1, fail=()):
        def sink(batch, n):
            if n in fail:
                raise RuntimeError("killed")
            batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

        q = changelog.stream(spark, f"file://{log}", since).writeStream.foreachBatch(sink).option("checkpointLocation", kept).start()
        try:
            q.processAllAvailable()
            return True
        except Exception:
            return False
        finally:
            q.stop()

    got = lambda: sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert run(since=5) and got() == list(range(6, 42))
    put(log, *range(42, 50))
    put(log, 50)
    assert not run(fail=(1,)) and got() == list(range(6, 42))  # dies within a batch
    put(log, 51, 52)
    assert run() and got() == list(range(6, 53))  # the batch again, with what it had, and then the next one
    os.remove(f"{log}/{1:09d}.json")  # the monitor drops what is done with
    put(log, 60)
    assert run() and got() == [*range(6, 53), 60] and changelog.done(log) >= 41
    assert run() and got() == [*range(6, 53), 60]


def test_a_batch_of_the_log(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert changelog.read(spark, log).collect() == [] and changelog.done(log) == -1
    put(log, *range(10))
    put(log, 10, 11, 12, junk=True)
    os.makedirs(f"{tmp_path}/empty", exist_ok=True)
    assert sorted(r.event_id for r in changelog.read(spark, log, 7).collect()) == [8, 9, 10, 11, 12]
    assert changelog.read(spark, log).filter("flags = 3").count() == 2 and changelog.read(spark, f"{tmp_path}/empty").count() == 0


def test_a_scan_by_frontier_shares_a_subtree_out(spark, tmp_path):
    """All folders lie below one child: a scan by static shares gives them to one task, this one doesn't."""
    top = tmp_path / "top"
    for i in range(40):
        (top / "only" / f"d{i}" / "deeper").mkdir(parents=True)
        for k in range(5):
            (top / "only" / f"d{i}" / "deeper" / f"f{k}.txt").write_text("x")
    (top / "only" / "node_modules" / "x").mkdir(parents=True)
    (top / "link").symlink_to(top / "only")
    rules = ExcludeRules()
    whole = {tuple(r) for r in fstree.scan(spark, [str(top), "/no/such"], rules).collect()}
    found = fstree.scan_by_frontier(spark, [str(top), "/no/such"], rules, each=30, tasks=8)
    rows = found.select("*", F.input_file_name().alias("file")).collect()
    assert {tuple(r)[:-1] for r in rows} == whole and len(rows) == len(whole)
    assert len({r.file for r in rows if "/deeper/" in r.path}) > 4
    deep = tmp_path / "deep"
    path = deep
    for _ in range(60):
        path = path / "d"
    path.mkdir(parents=True)
    assert fstree.scan_by_frontier(spark, [str(deep)], rules).count() == 61


def test_order_by_collation(spark):
    names = ["zebra", "Äpfel 10", "apfel 9", "Apfel 2", "éclair", "Eclair", "eclair", "öl", "Zoo", "o2", "résumé", "resume", "_x", "日本"]
    rows = [(i, None, f"/{n}", 0, 0, False, 1, True) for i, n in enumerate(names)]
    files = forest.build(spark.createDataFrame(rows, "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean"))
    got = [r.name[1:] for r in search(files, Request("", sort="collated")).collect()]
    assert got == ["_x", "Apfel 2", "apfel 9", "Äpfel 10", "Eclair", "eclair", "éclair", "o2", "öl", "resume", "résumé", "zebra", "Zoo", "日本"]
    assert [r.name[1:] for r in search(files, Request("", sort="collated", ascending=False)).collect()] == got[::-1]
