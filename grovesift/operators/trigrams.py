"""An optional index: runs of three characters of names, with the ids that hold them.

A stored index goes with a base of files, whose names its postings have too: what a search needs is looked up from the
rarest run on, and the files that hold it are read instead of all. A filter scan is the default, and what frequent runs get.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, trigrams
from ..plans.ast import And, Node, Or, Pattern, Text
from ..plans.patterns import both, compiled, either, texts

#: Buckets of a stored index, places that a bucket is dealt out to, and runs that are intersected for a text.
BUCKETS, PLACES, MOST_GRAMS = 64, 8, 3


def postings(files: DataFrame) -> DataFrame:
    """(trigram, id). Rows, not lists: a list of a common trigram would be as long as the table."""
    return files.filter("is_live").select(F.explode(trigrams(F.col("name_fold"))).alias("trigram"), "id")


def appended(index: DataFrame, files: DataFrame, indexed: int) -> DataFrame:
    """The index with the rows from id ``indexed`` on; ids of deleted rows stay, and are tested away on lookup."""
    return index.unionByName(postings(files.filter(F.col("id") >= indexed)))


def selectivity(index: DataFrame) -> DataFrame:
    """(trigram, n)."""
    return index.groupBy("trigram").agg(F.count("*").alias("n"))


def index_bytes(index: DataFrame) -> DataFrame:
    """The bytes of the postings: those of each trigram, and 8 of each id."""
    return index.agg(F.coalesce(F.sum(F.octet_length("trigram") + 8), F.lit(0)).cast("long").alias("bytes"))


def statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("id").alias("indexed_records"), F.count("*").alias("postings"), F.countDistinct("trigram").alias("trigrams"))


def candidates(index: DataFrame, term: str) -> DataFrame | None:
    """Ids whose names hold all trigrams of an ASCII term; None if the index can't tell (short or other terms)."""
    term = fold(term)
    grams = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    if not term.isascii() or not grams:
        return None
    found = index.filter(F.col("trigram").isin(grams)).groupBy("id").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == len(grams)).select("id")


def lookup(files: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """Live rows whose names hold the term: candidates, then the test itself."""
    test = F.col("name_fold").contains(fold(term))
    ids = candidates(index, term)
    rows = files.filter("is_live").filter(test)
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def write_index(named: DataFrame, place: str) -> None:
    """Writes the postings (gram, id, number) of (id, name_fold, number of the file), by buckets of runs, and how often each run occurs.

    All names have postings, those beyond ASCII too. A frequent run's bucket is dealt out by id.
    """
    n = F.length("name_fold")
    every = named.filter(n >= 3).select("name_fold", "id", "number", F.explode(F.sequence(F.lit(1), n - 2)).alias("at"))
    grams = every.withColumn("gram", F.substr("name_fold", F.col("at"), F.lit(3))).filter(F.instr("name_fold", F.col("gram")) == F.col("at"))  # once for a name
    rows = grams.select("gram", "id", "number", _bucket(F.col("gram")).alias("bucket"))
    # Nothing asks for an order within a run, and most of the sort would go into it.
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PLACES))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(f"{place}/postings")
    counts = _postings(named.sparkSession, place).groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{place}/counts")


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _postings(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema("gram string, id long, number long, bucket int").parquet(f"{place}/postings")


def needed(tree: Node, options) -> object:
    """What the folded name of every match holds: a formula of texts as in ``plans.patterns``, None if nothing is known."""
    if options.match_path:
        return None
    match tree:
        case And(parts):
            return both(needed(p, options) for p in parts)
        case Or(parts):
            return either(needed(p, options) for p in parts)
        case Text(term) if term.isascii() or not options.ignore_case:
            return both(t for t in re.split(r"[*?]+", fold(term)) if len(t) >= 3)
        case Pattern(regex):
            return _folded(compiled(regex, options.ignore_case).need)
    return None


def _folded(need) -> object:
    return fold(need) if isinstance(need, str) else need and (need[0], tuple(map(_folded, need[1])))


def _grams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def files_of(files: DataFrame, place: str, need, most: float) -> list[str] | None:
    """Those of ``files`` (number, file) that hold names with what is needed; None if more than ``most`` names may, so that a scan is due."""
    spark = files.sparkSession
    every = sorted({g for t in texts(need) for g in _grams(t)})
    counted = spark.read.schema("gram string, n long, bucket int").parquet(f"{place}/counts")
    found = dict.fromkeys(every, 0) | {r["gram"]: r["n"] for r in _of(counted, every).collect()}

    def bound(x) -> int:
        if isinstance(x, str):
            return min(found[g] for g in _grams(x))
        return min(map(bound, x[1])) if x[0] == "and" else sum(map(bound, x[1]))

    if bound(need) > most:
        return None
    postings_ = _postings(spark, place)

    def holding(x) -> DataFrame:
        """(id, number) of names: the rarest first, which the others only thin out."""
        if isinstance(x, str):
            first, *more = sorted(_grams(x), key=lambda g: (found[g], g))[:MOST_GRAMS]
            out = _of(postings_, [first]).select("id", "number")
            for g in more:
                out = out.join(_of(postings_, [g]).select("id"), "id", "left_semi")
            return out
        parts = [holding(p) for p in (sorted(x[1], key=bound) if x[0] == "and" else x[1])]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p.select("id"), "id", "left_semi") if x[0] == "and" else out.unionByName(p)
        return out

    return sorted(r["file"] for r in holding(need).select("number").distinct().join(F.broadcast(files), "number").collect())  # a row for each file


def _of(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Rows of some runs: their buckets are folders, and within these the scan skips other runs."""
    buckets = [r["b"] for r in rows.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
