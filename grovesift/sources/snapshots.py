"""Versioned snapshots of a files table: a base of Parquet files, folders of changes over it, and manifests.

A manifest names what belongs to a version. Its number is claimed by creating its file, which fails where there is one; the
newest manifest that can be read counts. So readers see the old version or the new one, also while a
writer is between its steps or has died there. Changes cost their own size; :meth:`SnapshotStore.maintain` folds them
into the base from time to time. All files are reached through Spark's file systems, local or remote.

A base is sorted by folder and path, and each of its files has a row in a table of ranges. A batch of changes asks for rows,
children or subtrees by path (:meth:`SnapshotStore.near`) and reads the files whose ranges these touch, not the table. With
``indexed``, a base also has postings of runs of three characters of its names; a search that needs rare ones reads
the files that hold them all (:meth:`SnapshotStore.searchable`), and scans where they are frequent.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DATA_VOLUME, fold_column
from ..operators import trigrams
from ..operators.forest import SCHEMA, compacted, needs_compaction
from ..operators.reconcile import overlay

FORMAT = 4
MOST_ISSUES = 100
#: Folders of changes over a base, at most, until it is written anew.
MOST_CHANGES = 32
#: Changed rows that are always left over a base, and the share of its rows up to which more are.
FEW_CHANGED, CHANGED_SHARE = 100_000, 0.25
#: A search takes the index if it needs at most this share of the rows.
INDEX_SHARE = 0.02
#: Beyond so many files, a search that would read more than this share of all files scans instead: naming them costs more than it spares.
FEW_FILES, SCAN_SHARE = 1_000, 0.5
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROW, CHILDREN, SUBTREE = "row", "children", "subtree"
#: Manifests that are kept beside the newest one.
KEPT_MANIFESTS = 2


@dataclass(frozen=True)
class Manifest:
    folder: str
    fingerprint: str
    last_event_id: int = 0
    revision: int = 1
    issues: list[list] = field(default_factory=list)
    format: int = FORMAT
    saved: float = 0.0
    changes: list[str] = field(default_factory=list)  # folders, oldest first
    retries: str = ""  # folder of paths to be inspected again
    largest_id: int = -1
    live: int = 0
    bytes: int = 0
    base_rows: int = 0
    changed_rows: int = 0
    deleted: int = 0  # rows that changes took away
    index: str = ""  # folder of the base's postings


def folder_column(path_fold):
    """What a base is sorted by first: the folder of a path; empty for what lies in ``/``."""
    return F.regexp_replace(path_fold, r"/[^/]*$", "")


def spans(path: str, what: str) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """The stretches of (folder, path) that hold a row, a folder's children, or all that is below it and itself."""
    front = path.rpartition("/")[0]
    own = [((front, path), (front, path))]
    if what == ROW:
        return own
    top = "" if path == "/" else path
    children = [((top, ""), (top + "\0", ""))]
    if what == CHILDREN:
        return children
    return [*own, *children, ((top + "/", ""), (top + "0", ""))]  # 0 follows / in the order of characters


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 0, indexed: bool = False):
        self.spark, self.root, self.rows_per_file, self.indexed = spark, root.rstrip("/"), rows_per_file, indexed
        self._known: dict[str, list[tuple]] = {}
        self._listed: dict[str, DataFrame] = {}
        self._idle: dict[str, float] = {}  # since when folders haven't been needed

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        try:
            stream = fs.open(p)
        except Exception:  # not there
            return None
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> bool:
        """Creates a file; False if there is one. A reader that meets it half written passes over it."""
        fs, place = self._fs(path)
        if fs.getScheme() == "file":  # whose create looks first, and then creates
            os.makedirs(os.path.dirname(where := place.toUri().getPath()), exist_ok=True)
            try:
                with os.fdopen(os.open(where, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as out:
                    out.write(text.encode())
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(place, False)
        except Exception:
            if fs.exists(place):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _numbers(self) -> list[int]:
        """The numbers of all manifests, newest first."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()), reverse=True)

    def _path(self, number: int) -> str:
        return f"{self.root}/manifest-{number:012d}.json"

    def manifest(self) -> Manifest | None:
        """The newest manifest that can be read; None if there is none of this format."""
        for number in self._numbers():
            try:
                m = Manifest(**json.loads(self._read(self._path(number)) or ""))
            except (ValueError, TypeError):  # cut short, or not ours
                continue
            return m if m.format == FORMAT else None
        return None

    def _publish(self, now: Manifest) -> Manifest:
        """Makes a manifest the newest one; raises if another writer has published meanwhile."""
        numbers = self._numbers()
        if not self._put(self._path(numbers[0] + 1 if numbers else 1), json.dumps(asdict(now))):
            raise RuntimeError("Another writer has published a version meanwhile.")
        fs, _ = self._fs(self.root)
        for number in numbers[KEPT_MANIFESTS:]:
            fs.delete(self._fs(self._path(number))[1], False)
        return now

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/{folder}")
        return folder

    def _with_retries(self, retries: DataFrame | None) -> str:
        return "" if retries is None or retries.isEmpty() else self._write(retries.select("path", "attempt", "due"), "r")

    def save(self, files: DataFrame, fingerprint: str, last_event_id: int = 0, issues: list | None = None, retries: DataFrame | None = None) -> Manifest:
        """Writes the live rows as a new base and makes it the current version."""
        before = self.manifest()
        # In the order of folders, so that a folder's children lie together, and a folder's subtree too.
        # The folder is a column meanwhile: as an expression of the sort it would be worked out in each comparison.
        order = ["_folder", "path_fold"]
        rows = files.filter("is_live").select(*SCHEMA.fieldNames(), folder_column(F.col("path_fold")).alias("_folder"))
        folder = self._write(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_folder"), "v")
        place = F.struct(folder_column(F.col("path_fold")).alias("folder"), F.col("path_fold").alias("path"))
        named = self._base(folder).select("*", F.col("_metadata.file_name").alias("file"))
        ranges = named.groupBy("file").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("id").alias("largest"), F.min("id").alias("least"))
        ranges.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{self.root}/{folder}/_ranges")
        rows, size, largest = self._ranges_table(folder).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("largest"), F.lit(-1))).first()
        index = ""
        if self.indexed:
            index = f"i-{uuid.uuid4().hex}"
            trigrams.write_index(named.join(F.broadcast(self._numbered(folder)), "file"), f"{self.root}/{index}")
        listed = [list(i) for i in (issues or [])[:MOST_ISSUES]]
        return self._publish(
            Manifest(folder, fingerprint, last_event_id, before.revision + 1 if before else 1, listed, FORMAT, time.time(), [], self._with_retries(retries), largest, rows, size, rows, index=index)
        )

    def append(self, changed: DataFrame, last_event_id: int, issues: list | None = None, retries: DataFrame | None = None) -> Manifest:
        """Publishes a version that differs in some rows: those of ``changed``, of which the ones that aren't live are gone."""
        before = self.manifest()
        if before is None:
            raise RuntimeError("There is no version to change.")
        now = replace(before, last_event_id=last_event_id, revision=before.revision + 1, saved=time.time(), retries=self._with_retries(retries), issues=before.issues if issues is None else [list(i) for i in issues[:MOST_ISSUES]])
        if not changed.isEmpty():
            folder = self._write(changed.select(*SCHEMA.fieldNames()), "c")
            rows, on = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}"), F.col("is_live")
            sums = [F.count_if(on), F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0))]
            n, size, gone, largest = rows.agg(*sums, F.count_if(~on), F.coalesce(F.max("id"), F.lit(-1))).first()
            old, old_size = self._near(before, rows.select("path", F.lit(ROW).alias("what"))).join(rows.select("id"), "id", "left_semi").agg(*sums).first()
            now = replace(
                now, changes=[*before.changes, folder], largest_id=max(before.largest_id, largest), live=before.live + n - old, bytes=before.bytes + size - old_size,
                changed_rows=before.changed_rows + n + gone, deleted=before.deleted + gone,
            )
        return self._publish(now)

    def _ranges_table(self, folder: str) -> DataFrame:
        kind = "file string, first struct<folder:string,path:string>, last struct<folder:string,path:string>, rows long, bytes long, largest long, least long, number long"
        return self.spark.read.schema(kind).parquet(f"{self.root}/{folder}/_ranges")

    def _numbered(self, folder: str) -> DataFrame:
        """(number, file) of a base's files: postings have numbers, since names are long."""
        return self._ranges_table(folder).select("number", "file")

    def _ranges(self, folder: str) -> list[tuple]:
        """(first, last, file) of a base's files, in order: a row for each file, not for rows of the table."""
        if folder not in self._known:
            rows = [(tuple(r["first"]), tuple(r["last"]), r["file"]) for r in self._ranges_table(folder).select("first", "last", "file").collect()]
            self._known = {folder: sorted(rows)}
        return self._known[folder]

    def touched(self, m: Manifest, asked: DataFrame) -> list[str]:
        """The base files whose ranges what is asked for (path, what) touches. What is asked for stays in its tasks."""
        ranges = self._ranges(m.folder)
        firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

        def find(batches):
            some: set[int] = set()
            for batch in batches:
                for path, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for low, high in spans(path, what):
                        some.update(range(bisect_left(lasts, low), bisect_right(firsts, high)))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(some), pa.int64())], ["at"])

        found = asked.select(fold_column(F.col("path")).alias("path"), "what").distinct().mapInArrow(find, "at long").distinct().collect()
        return [ranges[k][2] for k in sorted(r["at"] for r in found)]

    def _of_files(self, m: Manifest, names: list[str]) -> DataFrame:
        """The version's rows as far as they come from some of the base's files, and all changed ones."""
        read = self.spark.read.schema(SCHEMA)
        if len(names) > FEW_FILES:
            # Taken from the base's listing, in which all others are passed over, instead of looked up one by one. As a text, since a column
            # for each name is slow to make; the names are Spark's own.
            base = self._base(m.folder).filter(f"_metadata.file_name in ({str(names)[1:-1]})")
        elif names:
            # Many files are looked at in a job, by default with a task for each of up to 10,000 files.
            kept = self.spark.conf.get(LISTING_TASKS)
            self.spark.conf.set(LISTING_TASKS, str(self.spark.sparkContext.defaultParallelism))
            try:
                base = read.parquet(*(f"{self.root}/{m.folder}/{n}" for n in names))
            finally:
                self.spark.conf.set(LISTING_TASKS, kept)
        else:
            base = self.spark.createDataFrame([], SCHEMA)
        return overlay(base, self._changes(m)) if m.changes else base

    def _near(self, m: Manifest, asked: DataFrame) -> DataFrame:
        return self._of_files(m, self.touched(m, asked))

    def near(self, asked: DataFrame) -> DataFrame:
        """Rows around some paths: at least all that is asked for, in (path, what) with ``row``, ``children`` or ``subtree``."""
        m = self.manifest()
        if m is None:
            raise RuntimeError("There is no version.")
        return self._near(m, asked)

    def searchable(self, tree, options, m: Manifest | None = None) -> DataFrame | None:
        """A table with all rows that a filter tree may match: by the index where it needs rare texts, else the whole one."""
        m = m or self.manifest()
        return None if m is None else self.rows_of(m, self.chosen(m, tree, options))

    def named(self, m: Manifest, tree, options) -> list[str] | None:
        """The base files that the index names for a filter tree, however many; None if it can't tell, or its runs are frequent."""
        need = trigrams.needed(tree, options) if m.index else None
        return None if need is None else trigrams.files_of(self._numbered(m.folder), f"{self.root}/{m.index}", need, INDEX_SHARE * m.base_rows)

    def chosen(self, m: Manifest, tree, options) -> list[str] | None:
        """The base files that the index names for a filter tree; None if a scan is due: runs are frequent, or most files have them."""
        names = self.named(m, tree, options)
        many = names is not None and len(names) > FEW_FILES and len(names) > SCAN_SHARE * self._ranges_table(m.folder).count()
        return None if many else names

    def rows_of(self, m: Manifest, names: list[str] | None) -> DataFrame:
        """The version's rows as far as they come from some of the base's files (None: all), and all changed ones."""
        return self._whole(m) if names is None else self._of_files(m, names)

    def _base(self, folder: str) -> DataFrame:
        """A base as a table. Its files, which never change, are listed once."""
        found = self._listed.get(folder)
        if found is None:
            found = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}")
            self._listed = {folder: found}
        else:
            fs, place = self._fs(f"{self.root}/{folder}")
            if not fs.exists(place):
                raise FileNotFoundError(folder)
        return found

    def _whole(self, m: Manifest) -> DataFrame:
        files = self._base(m.folder)
        return overlay(files, self._changes(m)) if m.changes else files

    def load(self) -> tuple[DataFrame, Manifest] | None:
        m = self.manifest()
        if m is None:
            return None
        try:
            return self._whole(m), m
        except Exception:  # a folder is gone
            return None

    def _changes(self, m: Manifest) -> DataFrame:
        """The latest row of each changed id."""
        every = None
        for k, folder in enumerate(m.changes):
            one = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}").withColumn("_order", F.lit(k))
            every = one if every is None else every.unionByName(one)
        latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_order")))
        return every.withColumn("_latest", latest).filter("_latest = 1").drop("_latest", "_order")

    def retries(self, m: Manifest) -> DataFrame:
        """(path, attempt, due): what has to be inspected again, and when (seconds since 1970)."""
        kinds = "path string, attempt int, due double"
        return self.spark.read.schema(kinds).parquet(f"{self.root}/{m.retries}") if m.retries else self.spark.createDataFrame([], kinds)

    def maintain(self, compact: bool = False) -> bool:
        """Writes the base anew where many changes lie over it, or much of it is gone; ``compact`` also numbers the rows anew.

        Tells whether it did.
        """
        m = self.manifest()
        if m is None:
            return False
        many = len(m.changes) >= MOST_CHANGES or m.changed_rows > max(FEW_CHANGED, CHANGED_SHARE * m.base_rows)
        if not (compact or many or (m.deleted and needs_compaction(m.live, m.deleted))):
            return False
        files = self._whole(m)
        self.save(compacted(files) if compact else files, m.fingerprint, m.last_event_id, m.issues, self.retries(m))
        return True

    def open_or_build(self, fingerprint: str, build) -> tuple[DataFrame, Manifest]:
        """The saved table if it was made under the same rules and scope and is sound; otherwise what ``build`` makes, saved."""
        found = self.load()
        if found and found[1].fingerprint == fingerprint and not contaminated(found[0]):
            return found
        files, issues, event = build()
        self.save(files, fingerprint, event, issues)
        return self.load()

    def drop_old(self, keep: int = 2, after: float = 0.0, now: float | None = None) -> None:
        """Deletes all but the newest folders, those of the current version, and those that were needed within ``after`` seconds.

        Searches go on over the version with which they began, so ``after`` should be longer than they take.
        """
        fs, root = self._fs(self.root)
        now = time.time() if now is None else now
        found = sorted((s for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName()[:2] in ("v-", "c-", "r-", "i-")), key=lambda s: -s.getModificationTime())
        m = self.manifest()
        needed = {m.folder, m.retries, m.index, *m.changes} if m else set()
        idle = {s.getPath().getName(): s.getPath() for s in found[keep:] if s.getPath().getName() not in needed}
        self._idle = {n: self._idle.get(n, now) for n in idle}
        for name, place in idle.items():
            if now - self._idle[name] >= after:
                fs.delete(place, True)
                del self._idle[name]

    def invalidate(self) -> None:
        """Forgets all versions, after a scope was revoked; the newest manifest goes last, so that no older one comes back."""
        fs, _ = self._fs(self.root)
        for number in reversed(self._numbers()):
            fs.delete(self._fs(self._path(number))[1], False)

    def put_settings(self, settings: dict) -> None:
        """Keeps rules and scope, for the next start."""
        number = max(self._settings_numbers(), default=0)
        if not self._put(f"{self.root}/settings-{number + 1:012d}.json", json.dumps(settings)):
            raise RuntimeError("Another writer has changed the settings meanwhile.")

    def settings(self) -> dict | None:
        for number in sorted(self._settings_numbers(), reverse=True):
            try:
                return json.loads(self._read(f"{self.root}/settings-{number:012d}.json") or "")
            except ValueError:
                continue
        return None

    def _settings_numbers(self) -> list[int]:
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [int(n[9:-5]) for n in names if n.startswith("settings-") and n[9:-5].isdigit()]


def contaminated(files: DataFrame) -> bool:
    """Whether the data volume was indexed a second time under its own name, which no scan does."""
    return not files.filter(F.col("is_live") & (F.col("path") == DATA_VOLUME)).isEmpty()
