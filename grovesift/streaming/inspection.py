"""Looking at folders and items that changes point to, on the executors.

One row for each thing seen: ``folder`` (an inspected folder; its error, if it couldn't be read whole), ``child`` (what
it lists) and ``item`` (one whose size and time were asked for). Nothing here changes a table.
"""

from __future__ import annotations

import errno
import os
import stat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import below
from ..operators.rules import ExcludeRules, effective, inspectable
from ..sources.fstree import frontier, listing

SEEN = "kind string, parent_path string, name string, path string, size long, mtime long, mtime_ns long, is_dir boolean, error int"
#: Errors that prove that something is gone. Any other one proves nothing.
GONE = (errno.ENOENT, errno.ENOTDIR)
COLUMNS = [c.split()[0] for c in SEEN.split(", ")]


def look_at_folder(path: str, known_ns: int | None, forced: bool, rules: ExcludeRules) -> list[tuple]:
    """The rows of a folder; none if its time says that no entry came or went since it was last inspected."""
    try:
        now = os.stat(path, follow_symlinks=False).st_mtime_ns
    except OSError as e:
        return [("folder", None, None, path, None, None, None, None, e.errno)]
    if not forced and known_ns == now:
        return []
    rows, _ = listing(path, rules)
    if len(rows) == 1 and rows[0][0] is None:  # the folder itself couldn't be read
        return [("folder", None, None, path, None, None, None, None, rows[0][8])]
    failed = next((r[8] for r in rows if r[8] is not None and r[8] not in GONE), None)
    return [("folder", None, None, path, None, None, now, None, failed), *(("child", *r[:7], None) for r in rows if r[8] is None)]


def look_at_item(path: str) -> list[tuple]:
    try:
        s = os.stat(path, follow_symlinks=False)
    except OSError as e:
        return [("item", None, None, path, None, None, None, None, e.errno)]
    return [("item", None, None, path, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns, stat.S_ISDIR(s.st_mode), None)]


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def targets(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, forced) of the folders to be listed: stored ones that tasks name, and all stored folders below the deep ones."""
    folders = files.filter("is_live and is_dir")
    named = tasks.filter("task = 'list'").groupBy("path").agg(F.max("deep").alias("forced")).join(folders.select("path"), "path", "left_semi")
    deep = named.filter("forced").select("path")
    under = folders.join(below(F.col("path"), deep, folders), "id", "left_semi").select("path", F.lit(True).alias("forced"))
    return named.unionByName(under).groupBy("path").agg(F.max("forced").alias("forced"))


def inspector(rules: ExcludeRules = ExcludeRules(), mount_table: list[tuple[str, bool]] | None = None):
    """``inspect(tasks, files, gate)`` over the mounted file system; ``gate`` has (path, mtime_ns) of folders inspected before.

    Folders and items on mounts that aren't local aren't touched; they come back with an error, to be tried again.
    """
    from ..sources.fstree import mounts

    table = mounts() if mount_table is None else mount_table
    used = effective(rules, table)

    def folders(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rows += look_at_folder(r.path, None if pd.isna(r.mtime_ns) else int(r.mtime_ns), r.forced, used) if r.local else [("folder", None, None, r.path, None, None, None, None, errno.ENOTSUP)]
            yield frame(rows)

    def items(batches):
        for pdf in batches:
            yield frame([x for r in pdf.itertuples() for x in (look_at_item(r.path) if r.local else [("item", None, None, r.path, None, None, None, None, errno.ENOTSUP)])])

    def inspect(tasks: DataFrame, files: DataFrame, gate: DataFrame | None = None) -> DataFrame:
        spark = files.sparkSession
        where = spark.createDataFrame(table, "mount string, is_local boolean")
        listed = targets(tasks, files)
        known = gate if gate is not None else spark.createDataFrame([], "path string, mtime_ns long")
        asked = listed.join(known, "path", "left").join(inspectable(listed.select("path"), where), "path")
        wanted = tasks.filter("task = 'refresh'").select("path").distinct().join(files.filter("is_live").select("path"), "path", "left_semi")
        asked_items = inspectable(wanted, where)
        return asked.repartition("path").mapInPandas(folders, SEEN).unionByName(asked_items.repartition("path").mapInPandas(items, SEEN))

    def subtrees(roots: DataFrame) -> DataFrame:
        """All that lies below new folders (path), as ``child`` rows; with an error, what couldn't be read."""
        found = frontier(roots.select("path", F.lit(False).alias("first")), used)
        return found.select(F.lit("child").alias("kind"), *COLUMNS[1:])

    inspect.subtrees = subtrees
    return inspect
