"""Ways to hand results out."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_label, local_time, rfc3339

TSV_HEADER = ("Name", "Path", "Size", "Kind", "Date Modified")


def paths(results: list[dict], null: bool = False) -> str:
    """Paths, each followed by a line end or a null character."""
    end = "\0" if null else "\n"
    return "".join(r["path"] + end for r in results)


def write_paths(df: DataFrame, folder: str) -> None:
    df.select("path").write.text(folder)


def envelope(answer: dict) -> str:
    """The answer as JSON, version 1. What isn't known (of the first row, the root) is null."""

    def row(r: dict) -> dict:
        known = r["id"] != 0
        when = datetime.fromtimestamp(r["mtime"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if known else None
        return {"name": r["name"], "path": r["path"], "isDirectory": r["is_dir"], "size": r["size"] if known else None, "modified": when}

    return json.dumps({"schemaVersion": 1} | answer | {"results": [row(r) for r in answer["results"]]}, ensure_ascii=False)


def json_rows(df: DataFrame) -> DataFrame:
    """(json): a line of JSON for each row, made where the rows are."""
    known = F.col("id") != 0
    fields = F.struct("name", "path", F.col("is_dir").alias("isDirectory"), F.when(known, F.col("size")).alias("size"), F.when(known, rfc3339(F.col("mtime"))).alias("modified"))
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def tsv_rows(df: DataFrame) -> DataFrame:
    """(line): name, path, size (none for folders), kind and local time, parted by tabs; nothing is escaped."""
    size = F.when(F.col("is_dir"), "").otherwise(F.col("size").cast("string"))
    return df.select(F.concat_ws("\t", "name", "path", size, kind_label(F.col("is_dir"), F.col("name")), local_time(F.col("mtime"))).alias("line"))


def write_tsv(df: DataFrame, folder: str) -> None:
    """Files of lines, and the header as a file of its own that sorts first."""
    lines = tsv_rows(df)
    lines.sparkSession.createDataFrame([("\t".join(TSV_HEADER),)], "line string").coalesce(1).write.text(f"{folder}/0-header")
    lines.write.text(f"{folder}/1-rows")
