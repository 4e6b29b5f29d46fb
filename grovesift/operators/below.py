"""Rows below some folders, by equality of ancestors, without a task for what lies below ``/``.

Ancestors are looked up once for each folder of the table, not for each row. A few folders have very many rows below them, and all rows
lie below some of these. They are known from counts, which are added up in the tasks first, and looked up once; so the joins
have only the other folders, each with a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors

#: Rows from which a value is looked up apart, and the number of such values at most: the most frequent ones.
MANY, MOST_APART = 100_000, 1_000


def frequent(counted: DataFrame, many: int = 0) -> list:
    """The values of (value, n) that very many rows have; one that isn't among them has at most MANY, or a small share of all."""
    value = counted.columns[0]
    summed = counted.groupBy(value).agg(F.sum("n").alias("n")).filter(F.col("n") >= (many or MANY))
    return [r[0] for r in summed.orderBy(F.desc("n"), F.length(F.col(value).cast("string"))).limit(MOST_APART).collect()]


def outside(rows: DataFrame, folders: DataFrame, itself: bool = False, among: DataFrame | None = None, many: int = 0) -> DataFrame:
    """The rows (path, others) that lie below none of the folders (path), or, with ``itself``, are none of these either.

    ``among`` is a table that is cheaper to read and has the rows among others.
    """
    path, own = F.col("path"), F.regexp_replace("path", "/[^/]*$", "")  # the folder of a path; empty for what lies in ``/``
    inhabited = (rows if among is None else among).filter(path != "/").groupBy(own.alias("folder")).agg(F.count("*").alias("n"))
    apart = frequent(inhabited.select(F.explode(ancestors(F.col("folder"))).alias("above"), "n"), many)
    apart += [""] if "/" in apart else []
    rows = rows.join(folders.select("path"), "path", "left_anti").select(*rows.columns) if itself else rows
    cut = [r["path"] for r in folders.filter(path.isin(apart)).select("path").distinct().collect()] if apart else []
    if cut:  # with a folder all around it are apart
        rows = rows.filter((path == "/") | ~F.coalesce(F.exists(ancestors(own), lambda a: a.isin(cut)), F.lit(False)))
    rest = F.filter(ancestors(F.col("folder")), lambda a: ~a.isin(apart))
    above = inhabited.select("folder", F.explode(rest).alias("path"))
    inner = above.join(folders.select("path"), "path", "left_semi").select(F.col("folder").alias("_folder")).distinct()
    # What lies in a folder apart is through, and meets nothing; so does the root.
    met = F.when((path == "/") | own.isin(apart), F.concat(F.lit("\0"), "path")).otherwise(own)
    return rows.withColumn("_met", met).join(inner, F.col("_met") == F.col("_folder"), "left_anti").drop("_met")
