"""An engine that answers requests over published snapshots: admission, replacement, cancellation, settings and status."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from .errors import Busy, Cancelled, Denied, NotReady, QueryError, Unavailable
from .operators.rules import ExcludeRules, IndexScope
from .operators.search import Request, matches, respond
from .plans.parser import admit, parse
from .plans.values import MOST_ROWS
from .sources.snapshots import SnapshotStore

MOST_REQUESTS, MOST_BACKGROUND, MOST_SESSIONS = 32, 2, 8


class Admission:
    """Places for requests: ``most`` at once, ``background`` of them for background requests at most.

    Each of ``sessions`` sessions has one slot for what waits, and a newer request takes it from an older one. Places that become
    free go to the waiting sessions in turn, so that a busy session is served as often as a quiet one.
    """

    def __init__(self, most: int = MOST_REQUESTS, background: int = MOST_BACKGROUND, sessions: int = MOST_SESSIONS):
        self.most, self.background, self.sessions = most, background, sessions
        self.lock = threading.Condition()
        self.used = self.used_background = 0
        self.waiting: dict[str, object] = {}  # in the order of turns
        self.granted: set[object] = set()

    def enter(self, session: str, interactive: bool) -> None:
        """Returns with a place. Background requests and those without a session don't wait for one."""
        with self.lock:
            free = self.used < self.most
            if not interactive:
                if not free or self.used_background >= self.background:
                    raise Busy("Too many requests.")
                self.used_background += 1
                self.used += 1
                return
            if free and not self.waiting:
                self.used += 1
                return
            if not session or (session not in self.waiting and len(self.waiting) >= self.sessions):
                raise Busy("Too many requests.")
            mine = object()
            self.waiting[session] = mine  # an older request of the session finds its slot taken; its turn stays
            self._wake()
            while mine not in self.granted:
                if self.waiting.get(session) is not mine:
                    raise Cancelled("A newer request took the place of this one.")
                self.lock.wait()
            self.granted.discard(mine)

    def leave(self, interactive: bool) -> None:
        with self.lock:
            self.used -= 1
            self.used_background -= not interactive
            self._wake()

    def withdraw(self) -> None:
        """Ends all waiting."""
        with self.lock:
            self.waiting.clear()
            self.lock.notify_all()

    def _wake(self) -> None:
        while self.waiting and self.used < self.most:
            session = next(iter(self.waiting))
            self.granted.add(self.waiting.pop(session))
            self.used += 1
        self.lock.notify_all()


class Engine:
    """Searches run on the snapshot that is current when they begin; publishing another doesn't disturb them.

    Every answer belongs to the epoch in which it began. Switching access off, or revoking it, begins another epoch, cancels
    all that runs and waits, and frees what is kept in memory; an answer of an older epoch is never given.

    Jobs of interactive and background requests run in Spark's pools of these names, which share the executors fairly
    where the session has the fair scheduler.
    """

    def __init__(self, spark: SparkSession, store: SnapshotStore):
        self.spark, self.store = spark, store
        self.epoch, self.allowed = 0, True
        self.running: dict[str, str] = {}
        self.lock = threading.Lock()
        self.admission = Admission()
        self.active: set[str] = set()
        self.cancelled: set[str] = set()
        self.ordered: tuple | None = None
        self.scans = threading.Condition()
        self.scanning, self.asked, self.served = False, 0, 0

    def search(self, text: str, session: str = "", interactive: bool = True, **options) -> dict:
        """The answer to a query. A newer interactive request of a session replaces the one that runs or waits."""

        def work(epoch):
            m = self.store.manifest()
            if m is None:
                raise NotReady("Nothing is indexed yet.")
            request = Request(admit(text), **options)
            if not 1 <= request.limit <= MOST_ROWS:
                raise QueryError(f"limit must be from 1 to {MOST_ROWS}.")
            tree = parse(request.text, request.pattern_mode, request.now).tree
            return lambda: respond(self.store.searchable(tree, request.options, m), request)

        return self._answer(work, session, interactive)

    def _begun(self) -> int:
        with self.lock:
            if not self.allowed:
                raise Denied("Access is switched off.")
            return self.epoch

    def _same(self, epoch: int) -> None:
        with self.lock:
            if epoch != self.epoch:
                raise Denied("Access has changed.")

    def _answer(self, prepare, session: str, interactive: bool) -> dict:
        """Admits, runs and answers within one epoch. ``prepare`` gives the job, and refuses what can't be run."""
        epoch = self._begun()
        job = prepare(epoch)
        tag, replaces = f"grovesift-{uuid.uuid4().hex}", interactive and session
        if replaces:
            self.cancel_session(session)  # else what it replaces may hold the place it waits for
        try:
            self.admission.enter(session, interactive)
        except Cancelled:
            self._same(epoch)
            raise
        try:
            with self.lock:
                if epoch != self.epoch:
                    raise Denied("Access has changed.")
                self.active.add(tag)
                before = self.running.get(session) if replaces else None
                if replaces:
                    self.running[session] = tag
            if before:
                self.cancel(before)
            try:
                out = self._run(tag, job, "interactive" if interactive else "background")
            except Exception:
                self._same(epoch)
                raise
            self._same(epoch)
            return out
        finally:
            with self.lock:
                if self.running.get(session) == tag:
                    del self.running[session]
                self.active.discard(tag)
                self.cancelled.discard(tag)
            self.admission.leave(interactive)

    def _run(self, tag: str, work, pool: str):
        """Runs a job that can be cancelled by its tag: before it begins, while it runs, and until its result is out."""
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            if tag in self.cancelled:
                raise Cancelled("The search was cancelled.")
            try:
                out = work()
            except Exception as e:
                if tag in self.cancelled:
                    raise Cancelled("The search was cancelled.") from e
                raise
            if tag in self.cancelled:
                raise Cancelled("The search was cancelled.")
            return out
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Ends a request's jobs: those that run, and those that it was about to begin."""
        with self.lock:
            if tag not in self.active or tag in self.cancelled:
                return
            self.cancelled.add(tag)
        threading.Thread(target=self._interrupt, args=(tag,), daemon=True).start()

    def _interrupt(self, tag: str) -> None:
        while tag in self.active:
            self.spark.sparkContext.cancelJobsWithTag(tag)
            time.sleep(0.1)

    def cancel_session(self, session: str) -> None:
        with self.lock:
            tag = self.running.get(session)
        if tag:
            self.cancel(tag)

    def resorted(self, request: Request, sort: str, ascending: bool, session: str = "") -> dict:
        """The same matches in another order; they are kept in memory while the query, snapshot and epoch stay the same."""

        def work(epoch):
            m = self.store.manifest()
            if m is None:
                raise NotReady("Nothing is indexed yet.")
            key = (epoch, m.revision, replace(request, sort="id", ascending=True))

            def job():
                with self.lock:
                    if epoch != self.epoch:
                        raise Denied("Access has changed.")
                    if self.ordered is None or self.ordered[0] != key:
                        self._free()
                        self.ordered = (key, matches(self.store.searchable(request.plan.tree, request.options, m), request).persist())
                    kept = self.ordered[1]
                return respond(kept, replace(request, text="", sort=sort, ascending=ascending, limit=request.most))

            return job

        return self._answer(work, session, True)

    def _free(self) -> None:
        if self.ordered:
            self.ordered[1].unpersist()
        self.ordered = None

    def status(self) -> dict:
        """From the manifest; no rows are read."""
        m = self.store.manifest()
        if m is None:
            return {"ready": False, "allowed": self.allowed, "count": 0, "revision": 0, "issues": []}
        return {"ready": True, "allowed": self.allowed, "count": m.live, "bytes": m.bytes, "revision": m.revision, "lastEventID": m.last_event_id, "issues": m.issues}

    def ping(self, seconds: float = 2.0) -> bool:
        """Whether a trivial job is done in time; outside of all limits on requests."""
        done = threading.Event()
        threading.Thread(target=lambda: (self.spark.range(1).count(), done.set()), daemon=True).start()
        if not done.wait(seconds):
            raise Unavailable("The engine doesn't answer.")
        return True

    def rebuild(self, fingerprint: str, build) -> None:
        """Publishes what ``build`` makes; searches see the old snapshot until then.

        Requests that come while a scan runs share one that follows it.
        """
        with self.scans:
            self.asked += 1
            mine = self.asked
            while self.scanning and self.served < mine:
                self.scans.wait()
            if self.served >= mine:
                return
            self.scanning, covered = True, self.asked
        try:
            files, issues, event = build()
            self.store.save(files, fingerprint, event, issues)
            with self.scans:
                self.served = max(self.served, covered)
        finally:
            with self.scans:
                self.scanning = False
                self.scans.notify_all()

    def settings(self) -> tuple[ExcludeRules, IndexScope]:
        """The rules and the scope as last set."""
        kept = self.store.settings() or {}
        rules = ExcludeRules.from_json(kept["rules"]) if "rules" in kept else ExcludeRules()
        scope = kept.get("scope", {})
        return rules, IndexScope(scope.get("mode", "localVolumes"), tuple(scope.get("roots", ())), {k: tuple(v) for k, v in scope.get("identities", {}).items()})

    def configure(self, rules: ExcludeRules, scope: IndexScope, build) -> None:
        """Keeps rules and scope, forgets what was indexed under others, and publishes what ``build(rules, scope)`` makes."""
        self.store.put_settings({"rules": rules.to_json(), "scope": asdict(scope)})
        fingerprint, now = scope.fingerprint(rules), self.store.manifest()
        if now is None or now.fingerprint != fingerprint:
            self.store.invalidate()
            self.rebuild(fingerprint, lambda: build(rules, scope))

    def switch(self, on: bool) -> None:
        """Lets requests in, or ends all there are and refuses new ones."""
        with self.lock:
            if on:
                self.allowed = True
                return
            self.allowed, self.epoch = False, self.epoch + 1
            tags = list(self.active)
            self._free()
        self.admission.withdraw()
        for tag in tags:
            self.cancel(tag)

    def revoke(self) -> None:
        """Ends all requests and forgets everything, after access to the scope was withdrawn."""
        self.switch(False)
        self.store.invalidate()
