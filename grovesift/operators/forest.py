"""The files table: a forest of rows with materialised paths and folded columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension, fold_column
from ..scratch import drop, written
from .below import frequent, outside

SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("id", T.LongType()), ("parent", T.LongType()), ("name", T.StringType()), ("path", T.StringType()), ("depth", T.IntegerType()),
            ("size", T.LongType()), ("mtime", T.LongType()), ("is_dir", T.BooleanType()), ("vol_id", T.IntegerType()), ("is_live", T.BooleanType()),
            ("name_fold", T.StringType()), ("path_fold", T.StringType()), ("ext_fold", T.StringType()),
        )
    ]
)
RECORD = ("id", "name", "path", "parent", "size", "mtime", "is_dir", "vol_id")


def with_folds(rows: DataFrame) -> DataFrame:
    """Adds the derived columns. They are stored so that tests on them reach the Parquet scan."""
    name = fold_column(F.col("name"))
    return rows.withColumns({"name_fold": name, "path_fold": fold_column(F.col("path")), "ext_fold": extension(name)})


PLACED, OPEN, ORPHAN = 0, 1, 2
#: Bytes of rows that a partition of a join has, and those of a row beside its path.
PART_BYTES, ROW_BYTES = 32 << 20, 64


def chased(rows: DataFrame) -> tuple[DataFrame, int]:
    """(id, up, part, depth, state) of every row: its path and depth where a chain of parents leads to a root.

    By pointer doubling: each row holds a part of its path and the ancestor where that part begins, and takes the
    ancestor's part in front; so the number of rounds, each one join and a written table, is the logarithm of the
    depth, however deep. A row whose ancestor isn't there is an orphan, and so are all below it. While any chain ends, its rows
    of the next power of two of levels are closed in a round; a round that closes none leaves cycles, which stay open.

    Also the number of partitions for joins with these rows: by their bytes, since paths are far larger in memory than in a shuffle.
    """
    root = F.col("parent").isNull()
    steps = rows.select(
        "id", F.when(root, None).otherwise(F.col("parent")).alias("up"), F.col("name").alias("part"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), F.when(root, PLACED).otherwise(OPEN).alias("state")
    )
    steps, before = written(steps, "paths"), -1
    while True:
        left, size = steps.agg(F.count_if(F.col("state") == OPEN), F.coalesce(F.sum(F.octet_length("part") + ROW_BYTES), F.lit(0))).first()
        parts = size // PART_BYTES + 1
        if left in (0, before):
            return steps, parts
        above = steps.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("part").alias("front"), F.col("depth").alias("more"), F.col("state").alias("there"))
        still = steps.filter(F.col("state") == OPEN)
        apart = F.col("up").isin(frequent(still.select("up", F.lit(1).alias("n"))))  # whose rows would all meet in one task
        met = still.filter(~apart).repartition(parts, "up").join(above.repartition(parts, "up"), "up", "left")
        met = met.unionByName(still.filter(apart).join(F.broadcast(above.filter(apart)), "up", "left"))
        joint = F.when(F.col("front") == "/", F.lit("/")).otherwise(F.concat("front", F.lit("/")))
        lost = F.col("there").isNull() | (F.col("there") == ORPHAN)
        moved = met.select(
            "id", F.when(lost, F.col("up")).otherwise(F.col("further")).alias("up"), F.when(lost, F.col("part")).otherwise(F.concat(joint, "part")).alias("part"),
            F.when(lost, F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), F.when(lost, ORPHAN).otherwise(F.col("there")).alias("state"),
        )
        further = written(steps.filter(F.col("state") != OPEN).unionByName(moved), "paths")
        drop(steps)
        steps, before = further, left


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with paths, and issues (id, problem) of the rows that have none: ``orphan`` or ``cycle``, each with all below it.

    ``rows`` has id, parent, name, size, mtime, is_dir, vol_id and is_live; a root's name is its path.
    """
    steps, parts = chased(rows)
    paths = steps.filter(F.col("state") == PLACED).select("id", F.col("part").alias("path"), F.col("depth").cast("int").alias("depth"))
    issues = steps.filter(F.col("state") != PLACED).select("id", F.when(F.col("state") == ORPHAN, "orphan").otherwise("cycle").alias("problem"))
    return with_folds(rows.repartition(parts, "id").join(paths.repartition(parts, "id"), "id")).select(*SCHEMA.fieldNames()), issues


def build(rows: DataFrame) -> DataFrame:
    """Files with paths; rows that reach no root are left out, see :func:`placed`."""
    return placed(rows)[0]


def live(files: DataFrame) -> DataFrame:
    return files.filter("is_live")


def compacted(files: DataFrame) -> DataFrame:
    """Live rows under new ids 0, 1, ... in the order of the old ones; rows whose parent is gone go too, with all below them.

    Ids are counted within ranges of ids and added up from range to range, so that no task sees all rows.
    """
    files = written(files, "all")  # read several times
    rows = written(outside(live(files), files.filter(~F.col("is_live")).select("path")), "kept")
    drop(files)
    ids = written(rows.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("part")), "ids")
    sizes = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    number = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part")) if starts else F.lit(0)
    new = written(ids.select("id", (number + start).cast("long").alias("new")), "new")
    parents = new.select(F.col("id").alias("parent"), F.col("new").alias("new_parent"))
    return rows.join(new, "id").join(parents, "parent", "left").withColumns({"id": F.col("new"), "parent": F.col("new_parent")}).select(*SCHEMA.fieldNames())


def counts(files: DataFrame) -> DataFrame:
    """Live and deleted rows, folders and bytes, in one row."""
    on = F.col("is_live")
    return files.agg(
        F.count_if(on).alias("live"), F.count_if(~on).alias("deleted"), F.count_if(on & F.col("is_dir")).alias("folders"),
        F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0)).alias("bytes"),
    )


def needs_compaction(live_rows: int, deleted: int) -> bool:
    return deleted >= max(100_000, (live_rows + deleted) // 10)


def from_sales(spark, folder: str, live_only: bool = True) -> DataFrame:
    """A files table of the driver's tables: regions, nations and customers are folders, orders are files."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(o_orderdate AS TIMESTAMP_NTZ))")

    def row(df, id_, parent, name, path, depth, size=F.lit(0), mtime=F.lit(0), is_dir=True):
        return df.select(
            id_.cast("long").alias("id"), parent.cast("long").alias("parent"), name.alias("name"), path.alias("path"), F.lit(depth).alias("depth"),
            size.cast("long").alias("size"), mtime.cast("long").alias("mtime"), F.lit(is_dir).alias("is_dir"), F.lit(1).alias("vol_id"), F.lit(True).alias("is_live"),
        )

    c = F.col
    region = read("region").select("r_regionkey", "r_name", F.concat(F.lit("/"), "r_name").alias("r_path"))
    nation = read("nation").join(region, c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", F.concat("r_path", F.lit("/"), "n_name").alias("n_path"))
    customer = read("customer").join(nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_name", "c_nationkey", F.concat("n_path", F.lit("/"), "c_name").alias("c_path"))
    file_name = F.concat(F.lit("order-"), c("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_totalprice", seconds.alias("t"), file_name.alias("o_name")).join(customer, c("o_custkey") == c("c_custkey"))
    every = row(spark.range(1), F.lit(0), F.lit(None), F.lit("/"), F.lit("/"), 0)
    for part in (
        row(region, 1 + c("r_regionkey"), F.lit(0), c("r_name"), c("r_path"), 1),
        row(nation, 1000 + c("n_nationkey"), 1 + c("n_regionkey"), c("n_name"), c("n_path"), 2),
        row(customer, 1_000_000 + c("c_custkey"), 1000 + c("c_nationkey"), c("c_name"), c("c_path"), 3),
        row(orders, 1_000_000_000 + c("o_orderkey"), 1_000_000 + c("o_custkey"), c("o_name"), F.concat("c_path", F.lit("/"), "o_name"), 4, F.floor("o_totalprice"), c("t"), False),
    ):
        every = every.unionByName(part)
    return with_folds(every).select(*SCHEMA.fieldNames())
