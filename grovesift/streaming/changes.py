"""The change feed: which folders and items have to be looked at again, and applying what is found.

Events are (path, event_id, must_scan, structural, metadata, mount, dropped). They only say where to look; every
path is inspected anew, so late and repeated events do no harm, and no event-time state is kept.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DATA_VOLUME, canonical_column, within
from .inspection import GONE

# Bits of an event's flags.
FLAGS = {"must_scan": 0x1, "dropped": 0x2 | 0x4 | 0x8, "mount": 0x20 | 0x40 | 0x80, "structural": 0x100 | 0x200 | 0x800, "metadata": 0x400 | 0x1000 | 0x2000 | 0x4000 | 0x8000}


#: Columns of events.
EVENTS = "path string, event_id long, must_scan boolean, structural boolean, metadata boolean, mount boolean, dropped boolean"


def read_flags(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """A stream of events from files of JSON lines (path, event_id, flags) that a monitor adds to a folder; those after an event id."""
    return decoded(spark.readStream.schema("path string, event_id long, flags int").json(folder).filter(F.col("event_id") > after))


def decoded(flagged: DataFrame) -> DataFrame:
    """Events of (path, event_id, flags), as those sources give them."""
    path = canonical_column(F.col("path"))
    return flagged.select(path.alias("path"), "event_id", *(c.alias(k) for k, c in classify(F.col("flags")).items())).select(*[c.split()[0] for c in EVENTS.split(", ")])


def classify(flags: Column) -> dict[str, Column]:
    """Boolean columns for the bits of an event."""
    return {k: flags.bitwiseAND(F.lit(v)) != 0 for k, v in FLAGS.items()}


def parent_of(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def route(events: DataFrame, roots: list[str]) -> DataFrame:
    """(path, task, deep): what each event asks for; ``rebuild`` rows ask for a whole new scan.

    Lost history rebuilds, and within the roots so do mounts, structural events at a root, and subtree events at the root
    of a volume. Outside of the roots nothing is done. A subtree
    event lists its folder and all below; a structural one the parent; a metadata one refreshes the item; an event
    may be both. One without any flag lists the folder itself.
    """
    inside = F.lit(False)
    for r in roots:
        inside = inside | within(F.col("path"), r)
    at_root = F.col("path").isin(roots)
    volume = F.col("path").isin("/", DATA_VOLUME) | F.col("path").rlike(r"^/Volumes/[^/]*$")
    rebuild = F.col("dropped") | (inside & (F.col("mount") | (F.col("structural") & at_root) | (F.col("must_scan") & volume)))
    task = lambda kind, path, deep=False: F.struct(path.alias("path"), F.lit(kind).alias("task"), F.lit(deep).alias("deep"))
    none = F.lit(None).cast("struct<path:string,task:string,deep:boolean>")
    plain = ~(F.col("must_scan") | F.col("structural") | F.col("metadata"))
    ordinary = F.array(
        F.when(F.col("must_scan"), task("list", F.col("path"), True)).otherwise(none),
        F.when(F.col("structural") & ~F.col("must_scan"), task("list", parent_of(F.col("path")))).otherwise(none),
        F.when(F.col("metadata") & ~F.col("must_scan"), task("refresh", F.col("path"))).otherwise(none),
        F.when(plain, task("list", F.col("path"))).otherwise(none),
    )
    tasks = F.when(rebuild, F.array(task("rebuild", F.lit("/")))).when(inside, F.filter(ordinary, lambda t: t.isNotNull())).otherwise(F.array().cast("array<struct<path:string,task:string,deep:boolean>>"))
    return events.select("event_id", F.explode(tasks).alias("t")).select("event_id", "t.*")


def coalesced(routed: DataFrame) -> DataFrame:
    """(path, task, deep): each path once for each task, deep if any event asked for it. A partial aggregate, so hot paths shrink before they move."""
    return routed.groupBy("path", "task").agg(F.max("deep").alias("deep"))


def delay(attempt: Column) -> Column:
    """Seconds to wait after a number of attempts: 1, 2, 4 and so on to 60."""
    return F.least(F.lit(60), F.pow(F.lit(2), F.least(attempt - 1, F.lit(6))).cast("int"))


def retries(failed: DataFrame) -> DataFrame:
    """(path, attempt, delay): what failed once more, and the seconds to wait."""
    attempt = F.col("attempt") + 1
    return failed.select("path", attempt.alias("attempt"), delay(attempt).alias("delay"))


def cursor_row(batch: DataFrame, before: int) -> DataFrame:
    """(last_event): the largest event id of a batch, or that of before it."""
    return batch.agg(F.coalesce(F.greatest(F.max("event_id"), F.lit(before)), F.lit(before)).cast("long").alias("last_event"))


def cursor(before: int, batch: DataFrame, failed: bool) -> int:
    """The last event that needn't be seen again: nothing moves on while a path still has to be retried."""
    if failed:
        return before
    return cursor_row(batch, before).first()[0]


class LiveTable:
    """Keeps a snapshot store in line with a stream of events.

    ``inspect`` is what :func:`inspection.inspector` makes. ``rebuild()`` scans anew and returns a files table. What is
    published, also what has to be tried again and when, and the last event, is in the store, so that a new driver goes on where
    the last one was. When folders were inspected is kept for this run only: the first event of a run always inspects.

    A batch reads the part of the table that its paths touch. Paths that failed wait for their time: batches leave
    them alone until then, and :meth:`tick` looks at them without any event. ``clock`` gives seconds since 1970.
    """

    #: Seconds between two times that the store is maintained, and seconds for which folders outlive the versions that need them.
    MAINTENANCE, GRACE = 60.0, 600.0

    def __init__(self, store, fingerprint: str, roots: list[str], inspect, rebuild, listeners=(), clock=time.time):
        self.store, self.fingerprint, self.roots, self.inspect, self.rebuild, self.clock = store, fingerprint, roots, inspect, rebuild, clock
        self.listeners = list(listeners)
        self.gate: DataFrame | None = None
        self.turn = threading.RLock()  # events and ticks come from two streams
        self.maintained = clock()

    def apply(self, batch: DataFrame, _id: int = 0) -> None:
        """Brings the store in line with a batch of events; several requests to rebuild are one scan."""
        with self.turn:
            self._apply(batch)

    def tick(self) -> bool:
        """Looks at paths whose time has come, and maintains the store when its time has; tells whether it did either."""
        with self.turn:
            m, did = self.store.manifest(), False
            if m is None:
                return False
            if m.retries and not self.store.retries(m).filter(F.col("due") <= self.clock()).isEmpty():
                self._apply(self.store.spark.createDataFrame([], EVENTS))
                did = True
            if self.clock() - self.maintained >= self.MAINTENANCE:
                self.maintained = self.clock()
                did = self.store.maintain() or did
                self.store.drop_old(0, self.GRACE, self.clock())
            return did

    def _apply(self, batch: DataFrame) -> None:
        from ..scratch import drop, written

        manifest, now = self.store.manifest(), self.clock()
        waiting = self.store.retries(manifest)
        tasks = written(coalesced(route(batch, self.roots)), "tasks")
        end = cursor(manifest.last_event_id, batch, False)  # taken before anything is looked at; what happens meanwhile comes again
        if not tasks.filter("task = 'rebuild'").isEmpty():
            self._tell(self.store.save(self.rebuild(), self.fingerprint, end))
            drop(tasks)
            return
        due = waiting.filter(F.col("due") <= now)
        again = due.select("path", F.lit("list").alias("task"), F.lit(False).alias("deep"))
        asked = coalesced(tasks.unionByName(again))
        near = self.store.near(self.asked(asked))
        seen = written(self.inspect(asked, near, self.gate), "seen")
        changed = self.changed(near, seen, manifest.largest_id, asked)
        failed = seen.filter(F.col("error").isNotNull() & ~F.col("error").isin(*GONE)).select("path").distinct()
        attempt = (F.coalesce("attempt", F.lit(0)) + 1).cast("int")
        retry = failed.join(waiting.select("path", "attempt"), "path", "left").select("path", attempt.alias("attempt"), (F.lit(now) + delay(attempt)).alias("due"))
        # What isn't due waits on, unless an event had it looked at.
        later = waiting.filter(F.col("due") > now).join(seen.select("path"), "path", "left_anti")
        retry = written(retry.unionByName(later), "retry")
        self._remember(seen)
        if retry.isEmpty():
            retry = None
        issues = [[r["path"], r["error"]] for r in seen.filter("error is not null").select("path", "error").limit(100).collect()]
        self._tell(self.store.append(changed, cursor(manifest.last_event_id, batch, retry is not None), issues or None, retry))
        drop(tasks, seen, changed, *([retry] if retry is not None else []))
        self.store.maintain()

    @staticmethod
    def asked(tasks: DataFrame) -> DataFrame:
        """(path, what): the rows that tasks need."""
        kinds = F.when(F.col("task") == "refresh", F.array(F.lit("row"))).when(F.col("deep"), F.array(F.lit("subtree"))).otherwise(F.array(F.lit("row"), F.lit("children")))
        return tasks.select("path", F.explode(kinds).alias("what"))

    def changed(self, files: DataFrame, seen: DataFrame, largest: int, tasks: DataFrame) -> DataFrame:
        """What was seen, as rows for :func:`reconcile.overlay` (a written table); new ids are above ``largest``.

        Of folders that are gone all children go; of folders that couldn't be read whole none does. New folders
        come with all that is below them. ``files`` has the rows around what ``tasks`` name; those below folders that
        are gone are read when it is known which these are.
        """
        from ..operators import reconcile
        from ..operators.forest import SCHEMA, with_folds
        from ..scratch import drop, written

        ids = files.filter("is_live and is_dir").select(F.col("path").alias("parent_path"), F.col("id").alias("parent"))
        whole = F.col("error").isNull() | F.col("error").isin(*GONE)
        inspected = seen.filter("kind = 'folder'").select(F.col("path").alias("parent_path"), whole.alias("whole")).join(ids, "parent_path")
        listed = seen.filter("kind = 'child'").join(ids, "parent_path").select("parent", "name", "size", "mtime", "is_dir")
        diff = reconcile.diff(files.filter("is_live"), listed, inspected)
        partly = inspected.filter(~F.col("whole")).select("parent").withColumn("action", F.lit("delete"))
        diff = written(diff.join(partly, ["parent", "action"], "left_anti"), "diff")
        lost = diff.filter("(action = 'delete' and is_dir) or (action = 'replace' and not is_dir)").select("id")
        if not lost.isEmpty():
            gone = files.join(lost, "id", "left_semi").select("path", F.lit("subtree").alias("what"))
            files = self.store.near(self.asked(tasks).unionByName(gone))
        first = written(reconcile.changed_rows(files, diff, largest + 1), "changed")
        out = first
        roots = first.join(diff.filter("is_dir and action in ('insert', 'replace')").select("parent", "name"), ["parent", "name"], "left_semi").filter("is_live")
        more = None
        if not roots.isEmpty():
            depth = roots.select(F.col("path").alias("_top"), "depth", F.size(F.split("path", "/")).alias("_parts"), "vol_id")
            start = max(largest, first.agg(F.max("id")).first()[0]) + 1
            more = written(self.inspect.subtrees(roots.select("path")).filter("error is null").withColumn("id", F.monotonically_increasing_id() + start), "below")
            parents = roots.select(F.col("path").alias("parent_path"), F.col("id").alias("parent")).unionByName(more.filter("is_dir").select(F.col("path").alias("parent_path"), F.col("id").alias("parent")))
            from ..functions.text import ancestors

            tops = more.select("id", "path", F.explode(ancestors(F.col("path"))).alias("_top")).join(depth, "_top").select("id", (F.col("depth") + F.size(F.split("path", "/")) - F.col("_parts")).cast("int").alias("depth"), "vol_id")
            rows = more.join(parents, "parent_path").join(tops, "id").withColumn("is_live", F.lit(True))
            out = out.unionByName(with_folds(rows).select(*SCHEMA.fieldNames()))
        items = seen.filter("kind = 'item' and error is null").select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("is_dir").alias("_dir"))
        fresh = files.filter("is_live").join(items, "path").filter("is_dir = _dir and not (size <=> _size and mtime <=> _mtime)").withColumns({"size": F.col("_size"), "mtime": F.col("_mtime")})
        out = out.unionByName(fresh.join(first.select("id"), "id", "left_anti").select(*SCHEMA.fieldNames()))
        out = written(out, "changes")
        drop(diff, first, *([more] if more is not None else []))
        return out

    def _remember(self, seen: DataFrame) -> None:
        from ..scratch import drop, written

        now = seen.filter("kind = 'folder' and error is null").select("path", "mtime_ns")
        if now.isEmpty():
            return
        before = self.gate
        self.gate = written(now if before is None else before.join(now, "path", "left_anti").unionByName(now), "gate")
        if before is not None:
            drop(before)

    def _tell(self, manifest) -> None:
        for listener in self.listeners:
            listener(manifest)

    def deny(self, roots: list[str]) -> None:
        """Takes out subtrees that may not be read any more; searches that begin now don't see them."""
        from ..operators import reconcile

        m = self.store.manifest()
        gone = self.store.spark.createDataFrame([(r,) for r in roots], "path string")
        files = self.store.near(gone.withColumn("what", F.lit("subtree")))
        dead = files.join(reconcile.below(F.col("path"), gone, files), "id", "left_semi").withColumn("is_live", F.lit(False))
        self._tell(self.store.append(dead, m.last_event_id, None, self.store.retries(m)))

    def next_retry(self) -> float | None:
        """Seconds until something has to be tried again, 0 if that is due."""
        due = self.store.retries(self.store.manifest()).agg(F.min("due").alias("due")).first()["due"]
        return None if due is None else max(0.0, due - self.clock())

    def start_ticking(self, checkpoint: str):
        """Ticks once a second, whether events come or not."""
        beats = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return beats.writeStream.foreachBatch(lambda _batch, _id: self.tick()).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()

    def start(self, events: DataFrame, checkpoint: str):
        """Runs over a stream of events, twice a second, from the last event that the store has seen."""
        m = self.store.manifest()
        later = events.filter(F.col("event_id") > (m.last_event_id if m else -1))
        return later.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()

    def follow(self, folder: str, checkpoint: str):
        """Runs over a monitor's log, see :mod:`sources.changelog`, from the last event that the store has seen."""
        from ..sources import changelog

        m = self.store.manifest()
        return self.start(decoded(changelog.stream(self.store.spark, folder, m.last_event_id if m else -1)), checkpoint)

    def keep_running(self, events: DataFrame, checkpoint: str, tries: int = 5, wait: float = 2.0) -> None:
        """Runs until the stream ends; starts it again ``wait`` seconds after a failure, ``tries`` times in a row at most."""
        for k in range(tries):
            try:
                self.start(events, checkpoint).awaitTermination()
                return
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait)
