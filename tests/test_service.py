"""Access, admission and turns."""

import threading
import time

import pytest

from grovesift.errors import Busy, Cancelled, Denied
from grovesift.operators import forest
from grovesift.operators.search import Request
from grovesift.service import Admission, Engine
from grovesift.sources.snapshots import SnapshotStore


@pytest.fixture
def engine(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = [(0, None, "/", 0, 0, True, 1, True), (1, 0, "a.md", 5, 1, False, 1, True), (2, 0, "b.md", 4, 2, False, 1, True)]
    store.save(forest.build(spark.createDataFrame(rows, "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean")), "f", 1)
    return Engine(spark, store)


def during(engine, act):
    """Has something happen when a request's result is ready and not yet given."""
    run = engine._run

    def later(tag, work, pool):
        return run(tag, lambda: (work(), act())[0], pool)

    engine._run = later
    return lambda: setattr(engine, "_run", run)


@pytest.mark.parametrize("options", [{"interactive": False}, {}, {"session": "a"}])
@pytest.mark.parametrize("end", ["revoke", "switch"])
def test_no_answer_after_access_ends(engine, options, end):
    assert len(engine.search("ext:md", **options)["results"]) == 2
    again = during(engine, lambda: engine.revoke() if end == "revoke" else engine.switch(False))
    with pytest.raises(Denied):
        engine.search("ext:md", **options)
    again()
    with pytest.raises(Denied):
        engine.search("ext:md", **options)
    assert not engine.active and not engine.running and engine.admission.used == 0
    engine.switch(True)
    if end == "switch":
        assert len(engine.search("ext:md", **options)["results"]) == 2
    assert engine.status()["ready"] == (end == "switch")


def test_an_answer_of_an_older_epoch_is_not_given(engine):
    """Off and on again while a search runs: what it found belongs to the time before."""
    again = during(engine, lambda: (engine.switch(False), engine.switch(True)))
    with pytest.raises(Denied):
        engine.search("ext:md")
    again()
    assert len(engine.search("ext:md")["results"]) == 2


def test_kept_matches_end_with_access(engine):
    assert [r["id"] for r in engine.resorted(Request("ext:md"), "size", True)["results"]] == [2, 1]
    kept = engine.ordered[1]
    assert [r["id"] for r in engine.resorted(Request("ext:md"), "size", False)["results"]] == [1, 2] and engine.ordered[1] is kept
    engine.switch(False)
    assert engine.ordered is None and not kept.storageLevel.useMemory
    with pytest.raises(Denied):
        engine.resorted(Request("ext:md"), "size", True)
    engine.revoke()
    with pytest.raises(Denied):
        engine.resorted(Request("ext:md"), "size", True)


def test_jobs_that_run_are_cancelled(engine, spark):
    began, ended = threading.Event(), []

    def slow():
        began.set()
        return {"results": [spark.range(0, 1 << 42, 1, 4).selectExpr("sum(hash(id))").collect()]}

    def ask():
        try:
            engine._answer(lambda _: slow, "", False)
        except Exception as e:
            ended.append(e)

    t = threading.Thread(target=ask)
    t.start()
    began.wait(30)
    time.sleep(1)
    engine.revoke()
    t.join(60)
    assert not t.is_alive() and isinstance(ended[0], Denied)


def waits(admission, session, order):
    """A request that waits for its place in a thread, and tells when it has it."""

    def enter():
        try:
            admission.enter(session, True)
            order.append(session)
        except Cancelled:
            order.append(f"-{session}")

    seen, t = len(admission.waiting), threading.Thread(target=enter)
    t.start()
    while len(admission.waiting) == seen and t.is_alive() and session not in admission.waiting:
        time.sleep(0.005)
    time.sleep(0.05)
    return t


def test_a_busy_session_doesnt_starve_another():
    admission, order = Admission(most=1), []
    admission.enter("other", True)
    threads = [waits(admission, "busy", order), waits(admission, "quiet", order), waits(admission, "busy", order), waits(admission, "busy", order)]
    assert order == ["-busy", "-busy"] and list(admission.waiting) == ["busy", "quiet"]  # one slot for a session, the latest request in it
    admission.leave(True)
    threads[3].join(10)
    threads.append(waits(admission, "busy", order))  # again, while the other one waits
    admission.leave(True)
    threads[1].join(10)
    assert order[2:] == ["busy", "quiet"]
    admission.leave(True)
    for t in threads:
        t.join(10)
    admission.leave(True)
    assert order[2:] == ["busy", "quiet", "busy"] and admission.used == 0


def test_places():
    admission = Admission(most=4, background=2, sessions=2)
    for _ in range(2):
        admission.enter("", False)
    with pytest.raises(Busy):
        admission.enter("", False)
    admission.enter("a", True)
    admission.enter("", True)
    with pytest.raises(Busy):  # all places taken, and nothing to wait in
        admission.enter("", True)
    order = []
    threads = [waits(admission, s, order) for s in "xy"]
    with pytest.raises(Busy):
        admission.enter("z", True)
    admission.withdraw()
    for t in threads:
        t.join(10)
    assert sorted(order) == ["-x", "-y"]
    for interactive in (False, False, True, True):
        admission.leave(interactive)
    assert admission.used == admission.used_background == 0
