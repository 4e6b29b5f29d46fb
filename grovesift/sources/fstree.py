"""A Spark data source over directory trees: ``spark.read.format("fstree").option("roots", ...)``.

Rows are (parent_path, name, path, size, mtime, mtime_ns, is_dir, hidden, error). Folders and hidden entries have
rows as any others; links aren't followed; a folder that can't be listed yields a row with its error and the scan
goes on. Excluded folders aren't entered.

The driver walks the first levels until there are enough folders to share out (``partitions``, by default 64), and
each task walks its own below; :func:`scan_by_frontier` deals out anew what is left after each round, which suits trees whose
folders differ much in size. Where the tree is mounted on every executor the scan runs on all of them.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.rules import MARKERS, ExcludeRules, IndexScope, effective

SCHEMA = "parent_path string, name string, path string, size long, mtime long, mtime_ns long, is_dir boolean, hidden boolean, error int"


def entry(parent: str | None, name: str, path: str, s: os.stat_result | None, error: int | None = None) -> tuple:
    is_dir = bool(s) and stat.S_ISDIR(s.st_mode)
    return (parent, name, path, s.st_size if s else 0, s.st_mtime_ns // 10**9 if s else 0, s.st_mtime_ns if s else 0, is_dir, name.startswith("."), error)


def listing(folder: str, rules: ExcludeRules) -> tuple[list[tuple], list[str]]:
    """The rows of a folder's children that the rules leave, and which of them are folders. A link in the folder's place isn't followed."""
    try:
        handle = os.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
    except OSError as e:
        return [entry(None, "", folder, None, e.errno)], []
    try:
        names = os.listdir(handle)
        project = any(n in MARKERS for n in names)
        rows, folders = [], []
        for name in names:
            path = f"/{name}" if folder == "/" else f"{folder}/{name}"
            if rules.excludes(name, path, name.startswith("."), project):
                continue
            try:
                s = os.stat(name, dir_fd=handle, follow_symlinks=False)
            except OSError as e:
                rows.append(entry(folder, name, path, None, e.errno))
                continue
            row = entry(folder, name, path, s)
            if row[6]:
                folders.append(path)
            elif rules.excludes_file(name):
                continue
            rows.append(row)
        return rows, folders
    except OSError as e:
        return [entry(None, "", folder, None, e.errno)], []
    finally:
        os.close(handle)


def walk(roots: list[str], rules: ExcludeRules) -> Iterator[tuple]:
    """All rows below some folders."""
    queue = deque(roots)
    while queue:
        rows, folders = listing(queue.popleft(), rules)
        queue.extend(folders)
        yield from rows


class Share(InputPartition):
    def __init__(self, rows: list[tuple], folders: list[str]):
        self.rows, self.folders = rows, folders


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.rules = ExcludeRules.from_json(options.get("rules", "{}"))
        self.wanted = int(options.get("partitions", 64))

    def partitions(self):
        rows, queue = [], deque()
        for r in self.roots:
            try:
                s = os.stat(r, follow_symlinks=False)
                rows.append(entry(None, r, r, s))
                if stat.S_ISDIR(s.st_mode):
                    queue.append(r)
            except OSError as e:
                rows.append(entry(None, r, r, None, e.errno))
        level = 0
        while queue and len(queue) < self.wanted and level < 10_000:
            found, folders = listing(queue.popleft(), self.rules)
            rows += found
            queue.extend(folders)
            level += 1
        shares = [Share([], list(queue)[k :: self.wanted]) for k in range(min(self.wanted, len(queue)))]
        return [Share(rows, []), *shares]

    def read(self, partition):
        yield from partition.rows
        yield from walk(partition.folders, self.rules)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "fstree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], rules: ExcludeRules = ExcludeRules(), partitions: int = 64) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("fstree").option("roots", json.dumps(roots)).option("rules", rules.to_json()).option("partitions", partitions).load()


def scan_by_frontier(spark: SparkSession, roots: list[str], rules: ExcludeRules = ExcludeRules(), each: int = 20_000, tasks: int | None = None) -> DataFrame:
    """The rows of :func:`scan`, in rounds, see :func:`frontier`."""
    return frontier(spark.createDataFrame([(r, True) for r in roots], "path string, first boolean"), rules, each, tasks)


def frontier(start: DataFrame, rules: ExcludeRules, each: int = 20_000, tasks: int | None = None) -> DataFrame:
    """All rows below some folders (path, first), and those of the folders that are ``first``.

    In rounds: what a round leaves is dealt out anew, so that no subtree is the work of one task.
    A task lists folders until it has met ``each`` entries, and hands the others of its share back. Folders that are
    waiting are a written table; the driver asks whether there are any and no more.
    """
    from ..scratch import written

    spark = start.sparkSession
    kinds, n = SCHEMA + ", waits boolean", tasks or 2 * spark.sparkContext.defaultParallelism
    columns = [c.split()[0] for c in kinds.split(", ")]

    def advance(batches):
        queue, met = deque(), 0
        for pdf in batches:
            rows = []
            for path, first in zip(pdf["path"], pdf["first"], strict=True):
                if not first:
                    queue.append(path)
                    continue
                try:
                    s = os.stat(path, follow_symlinks=False)
                    rows.append((*entry(None, path, path, s), False))
                    if stat.S_ISDIR(s.st_mode):
                        queue.append(path)
                except OSError as e:
                    rows.append((*entry(None, path, path, None, e.errno), False))
            while queue and met < each:
                found, folders = listing(queue.popleft(), rules)
                queue.extend(folders)
                met += len(found) + 1
                rows += [(*r, False) for r in found]
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=columns, dtype=object)
        while queue:
            some = [queue.popleft() for _ in range(min(10_000, len(queue)))]
            yield pd.DataFrame([(None, None, p, *[None] * 6, True) for p in some], columns=columns, dtype=object)

    waiting, out = start, None
    while out is None or not waiting.isEmpty():
        made = written(waiting.repartition(n, F.xxhash64("path")).mapInPandas(advance, kinds), "frontier")
        waiting = made.filter("waits").select("path", F.lit(False).alias("first"))
        some = made.filter("not waits").drop("waits")
        out = some if out is None else out.unionByName(some)
    return out


def scan_scope(spark: SparkSession, scope: IndexScope, rules: ExcludeRules = ExcludeRules(), mount_table: list[tuple[str, bool]] | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows of a scope, and issues of roots that no longer are the folders that were chosen.

    Mounts that aren't local are left out like excluded paths. The scope of all local volumes is the whole disk.
    """
    good, lost = scope.valid_roots()
    return scan_by_frontier(spark, good, effective(rules, mounts() if mount_table is None else mount_table)), lost


def with_progress(scanned: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The rows, and an observation that tells how many have passed once they have been written."""
    seen = Observation(name)
    return scanned.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors")), seen


def issues(scanned: DataFrame, most: int = 100) -> DataFrame:
    """(path, error_code) of what couldn't be read; a report, so its length is bounded."""
    return scanned.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("error_code")).limit(most)


def as_rows(scanned: DataFrame, first_id: int = 0, under: int | None = None, vol_id: int = 1) -> DataFrame:
    """Rows for ``forest.build``: ids that count within partitions, parents found by path. Roots carry no size and time.

    With ``under`` the roots are left out, and what lies in them has that id as its parent: the subtree of a row that
    is there already.
    """
    from ..scratch import written

    good = scanned.filter("error is null")
    numbered = written(good.withColumn("id", F.monotonically_increasing_id() + first_id), "scan")
    parents = numbered.filter("is_dir").select(F.col("path").alias("parent_path"), F.col("id").alias("parent"))
    top = F.col("parent_path").isNull()
    rows = numbered.join(parents, "parent_path", "left")
    if under is not None:
        roots = numbered.filter("parent_path is null").select(F.col("id").alias("_root"))
        rows = rows.filter(~top).join(roots, F.col("parent") == F.col("_root"), "left").withColumn("parent", F.when(F.col("_root").isNotNull(), under).otherwise(F.col("parent")))
    return rows.select("id", "parent", "name", F.when(top, 0).otherwise(F.col("size")).cast("long").alias("size"), F.when(top, 0).otherwise(F.col("mtime")).cast("long").alias("mtime"), "is_dir", F.lit(vol_id).alias("vol_id"), F.lit(True).alias("is_live"))


def mounts(text: str | None = None) -> list[tuple[str, bool]]:
    """(mount, is_local) of the system's mount table, or of a text in its form."""
    if text is None:
        with open("/proc/mounts", encoding="utf-8", errors="replace") as f:
            text = f.read()
    remote = {"nfs", "nfs4", "cifs", "smb3", "smbfs", "afpfs", "webdav", "fuse.sshfs", "ceph", "glusterfs", "9p"}
    rows = [line.split(" ") for line in text.splitlines() if line.count(" ") >= 2]
    return [(r[1].replace("\\040", " "), r[2] not in remote) for r in rows]
