"""Bringing a files table in line with listings of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from .forest import SCHEMA, with_folds

FIELDS = ("id", "size", "mtime", "is_dir")


def diff(existing: DataFrame, listed: DataFrame, inspected: DataFrame | None = None) -> DataFrame:
    """(parent, name, action, id, size, mtime, is_dir): how children as stored differ from children as listed.

    ``insert``: listed only; ``delete``: stored only; ``replace``: a file became a folder or the other way round;
    ``update``: another size or mtime; ``same``. Names are compared exactly. ``listed`` has (parent, name, size,
    mtime, is_dir) of the folders that were inspected; only these folders' stored children count. ``inspected`` (parent)
    names these folders, the emptied ones too; without it they are those that have listed children.
    """
    inspected = listed.select("parent").distinct() if inspected is None else inspected.select("parent")
    return diff_in(existing.join(inspected, "parent", "left_semi"), listed)


def diff_in(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """The same where ``existing`` already holds just the children of inspected folders, emptied ones too."""
    old = existing.select("parent", "name", *(F.col(c).alias(f"old_{c}") for c in FIELDS))
    new = listed.select("parent", "name", *(F.col(c).alias(f"new_{c}") for c in FIELDS[1:]), F.lit(True).alias("there"))
    both = old.join(new, ["parent", "name"], "full_outer")
    action = (
        F.when(F.col("old_id").isNull(), "insert").when(F.col("there").isNull(), "delete").when(~F.col("old_is_dir").eqNullSafe(F.col("new_is_dir")), "replace")
        .when(~(F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_mtime").eqNullSafe(F.col("new_mtime"))), "update").otherwise("same")
    )
    return both.select("parent", "name", action.alias("action"), F.col("old_id").alias("id"), *(F.when(F.col("there"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in FIELDS[1:]))


def stale(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored children that are listed no more."""
    return existing.join(listed.select("parent", "name"), ["parent", "name"], "left_anti")


def below(path: Column, roots: DataFrame, files: DataFrame, itself: bool = True) -> DataFrame:
    """Ids of files below any of some roots (path), and of the roots themselves: an equality join on ancestors."""
    above = ancestors(path) if itself else F.filter(ancestors(path), lambda a: a != path)
    every = files.select("id", F.explode(above).alias("_above"))
    return every.join(roots.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("id").distinct()


def overlay(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with some rows in another state: ``changed`` has them whole, and those that aren't live are left out."""
    kept = files.join(changed.select("id"), "id", "left_anti")
    return kept.select(*SCHEMA.fieldNames()).unionByName(changed.filter("is_live").select(*SCHEMA.fieldNames()))


def child_path(front: Column, name: Column) -> Column:
    return F.when(front == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(front, F.lit("/"), name))


def changed_rows(files: DataFrame, changes: DataFrame, first_id: int) -> DataFrame:
    """What changes do to a table, for :func:`overlay`: rows with new sizes and times, new rows, and rows that are live no more.

    Whatever is deleted or replaced goes with all that is below it. New ids count from ``first_id`` within a range
    each for a partition, so they are unique and need no common counter.
    """
    dead = files.join(_lost(files, changes), "id", "left_semi").withColumn("is_live", F.lit(False))
    newer = files.join(_news(changes), "id").join(dead.select("id"), "id", "left_anti").withColumns({"size": F.col("_size"), "mtime": F.col("_mtime")})
    columns = SCHEMA.fieldNames()
    return dead.select(*columns).unionByName(newer.select(*columns)).unionByName(_added(files, changes, first_id))


def _lost(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of all that goes."""
    gone = changes.filter(F.col("action").isin("delete", "replace")).select("id").join(files.select("id", "path"), "id").select("path")
    return below(F.col("path"), gone, files)


def _news(changes: DataFrame) -> DataFrame:
    return changes.filter("action = 'update'").select("id", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_new"))


def _added(files: DataFrame, changes: DataFrame, first_id: int) -> DataFrame:
    parents = files.select(F.col("id").alias("parent"), F.col("path").alias("_front"), (F.col("depth") + 1).alias("depth"), "vol_id")
    added = changes.filter(F.col("action").isin("insert", "replace")).drop("id").join(parents, "parent").withColumns(
        {"id": F.monotonically_increasing_id() + first_id, "path": child_path(F.col("_front"), F.col("name")), "is_live": F.lit(True)}
    )
    return with_folds(added).select(*SCHEMA.fieldNames())


def apply(files: DataFrame, changes: DataFrame, first_id: int) -> DataFrame:
    """A new table: the rows that stay, with new sizes and times, and the inserted ones; see :func:`changed_rows`."""
    kept = files.join(_lost(files, changes), "id", "left_anti").join(_news(changes), "id", "left")
    newer = kept.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("size", "mtime")})
    return newer.select(*SCHEMA.fieldNames()).unionByName(_added(files, changes, first_id))


def resolve(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id): the live rows of exact paths (path)."""
    return files.filter("is_live").join(paths.select("path").distinct(), "path", "left_semi").select("path", "id")


def children(files: DataFrame, parent: int, name: str | None = None) -> DataFrame:
    """The live children of a folder, or the one of an exact name."""
    found = files.filter(F.col("is_live") & (F.col("parent") == parent))
    return found if name is None else found.filter(F.col("name") == name)


def deny(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The table without the subtrees that may not be read any more."""
    return files.join(below(F.col("path"), roots, files), "id", "left_anti")


def refresh(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Sizes and times of items (path, size, mtime, is_dir) that still are what they were; nothing else changes."""
    news = seen.select("path", F.col("is_dir").alias("_dir"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    met = files.join(news, "path", "left")
    same = F.coalesce(F.col("_dir") == F.col("is_dir"), F.lit(False)) & F.col("is_live")
    return met.withColumns({c: F.when(same, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("size", "mtime")}).select(*SCHEMA.fieldNames())
