"""Search over a files table: one filter, and the first rows of an order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import natural_key
from ..plans.ast import Plan
from ..plans.compile import Options, to_column
from ..plans.parser import parse
from ..plans.values import MOST_ROWS
from .forest import RECORD

#: Sort keys, all of them ended by what makes the order total.
KEYS = {
    "name": lambda: ["name_fold", "path", "id"],
    "path": lambda: [natural_key(F.col("path")), "path", "id"],
    "collated": lambda: [F.collate(natural_key(F.col("path")), "UNICODE"), "path", "id"],  # as people sort: accents and case break ties only
    "size": lambda: ["size", "id"],
    "mtime": lambda: ["mtime", "id"],
    "kind": lambda: [~F.col("is_dir"), "ext_fold", "name_fold", "id"],
    "id": lambda: ["id"],
}


def order(key: str = "name", ascending: bool = True) -> list[Column]:
    """The columns of an order; descending turns every one of them round."""
    columns = [F.col(c) if isinstance(c, str) else c for c in KEYS[key]()]
    return [c.asc() if ascending else c.desc() for c in columns]


@dataclass(frozen=True)
class Request:
    text: str
    match_path: bool = False
    ignore_case: bool = True
    whole_word: bool = False
    pattern_mode: bool = False
    sort: str = "name"
    ascending: bool = True
    limit: int = 5000
    now: datetime | None = None

    @property
    def plan(self) -> Plan:
        return parse(self.text, self.pattern_mode, self.now)

    @property
    def options(self) -> Options:
        return Options(self.match_path, self.ignore_case, self.whole_word)

    @property
    def most(self) -> int:
        """How many rows are returned: what is asked for, and what the query itself allows."""
        return min(max(1, self.limit), self.plan.limit or MOST_ROWS, MOST_ROWS)


def matches(files: DataFrame, request: Request) -> DataFrame:
    """All live rows that match, in no order."""
    return files.filter("is_live").filter(to_column(request.plan.tree, request.options))


def matches_of(files: DataFrame, requests: list[Request]) -> DataFrame:
    """All live rows that match any of some requests, each with a row for every request's text (``term``), from one scan."""
    tests = [to_column(r.plan.tree, r.options) for r in requests]
    terms = F.array_compact(F.array(*(F.when(t, F.lit(r.text)) for t, r in zip(tests, requests, strict=True))))
    return files.filter("is_live").filter(reduce(or_, tests)).withColumn("term", F.explode(terms))


def search(files: DataFrame, request: Request) -> DataFrame:
    """The first rows that match: each task keeps its own first rows, and these are merged."""
    return matches(files, request).orderBy(*order(request.sort, request.ascending)).limit(request.most).select(*RECORD)


def search_or_nothing(files: DataFrame, request: Request) -> DataFrame:
    """The same, but no rows for a query that can't be understood."""
    try:
        return search(files, request)
    except QueryError:
        return files.limit(0).select(*RECORD)


def respond(files: DataFrame, request: Request, scanning: bool = False) -> dict:
    """The answer as a message. One row more than asked for is read, which tells whether there are more."""
    most = request.most
    rows = matches(files, request).orderBy(*order(request.sort, request.ascending)).limit(most + 1).select(*RECORD).collect()
    return {"results": [r.asDict() for r in rows[:most]], "returnedCount": min(len(rows), most), "limit": most, "truncated": len(rows) > most, "scanning": scanning}


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in either."""
    return a.select("id").union(b.select("id")).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in just one."""
    tagged = a.select("id").distinct().union(b.select("id").distinct())
    return tagged.groupBy("id").count().filter("count = 1").select("id")
