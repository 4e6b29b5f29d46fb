"""Hard-negative mining: the scores of anchors against all rows as a product of blocked matrices.

1. Rows are quantised, made distinct, and sharded: a task packs ``ROWS`` of them into a block, and cuts a block into chunks of
   ``CHUNK`` dimensions. Anchors are packed alike, ``ANCHORS`` to a block.
2. Blocks are dealt out over a grid of cells (anchor blocks by row blocks by chunk). Each side is repeated along the other
   axis of the grid only, so that what is sent grows with the sides of the grid, not with the number of block pairs.
3. A cell multiplies its blocks chunk by chunk, which gives partial tiles of scores; a tile is sent as one strip for each anchor, in the
   narrowest integers that hold it, after a head that names its rows and labels.
4. Where the strips of a tile meet they are added in 64 bits. Each tile gives an anchor's first positives within the tile, and
   those negatives that can still be in a window: as the tile's own positives bound the worst positive from below, a negative
   below the least window is in none. Nothing else is left out.
5. Tile positives are reduced to the first ones of each anchor; with their scores every tile gives the first negatives of each
   window, and these are reduced to the first ones of each anchor and positive.

The work is the number of anchors times that of rows; no pairs are rows of a table, and no label, row or copy however
frequent fills a task.

Defined results: rows without an id, a label or a vector, and those with a null or non-finite component take no part; rows
that repeat (id, label, quantised vector) count once; rows that share an id and differ are rows of their own, never each
other's positives or negatives, and as anchors have results of their own; missing components of shorter vectors are 0; ties
go to the smaller id; a positive of negative score has an empty window; an empty table, or one without anchors, gives no rows;
other columns are ignored. Scores have to fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_per_batch, materialize

ROWS, ANCHORS, CHUNK = 2048, 512, 32
BLOCK = ("n", "w", "ids", "labels", "x")


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def integers(b: bytes, n: int) -> np.ndarray:
    """``n`` equally wide integers."""
    return np.frombuffer(b, f"<i{len(b) // n}" if n else np.int8)


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """Distinct (vec_id, label, v) of the rows that take part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).distinct()


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` rows at most, in chunks of ``w`` dimensions: block, k, n, w, and ids and labels with the first chunk."""

    def pack(batches):
        at = TaskContext.get().partitionId() << 32
        ids, labels, vectors = [], [], []

        def full():
            width = max([1, *map(len, vectors)])
            m = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            chunks = [narrow(m[:, c : c + CHUNK]) for c in range(0, width, CHUNK)]
            k = len(chunks)
            heads = [np.array(x, np.int64).tobytes() for x in (ids, labels)]
            columns = [[at] * k, range(k), [len(ids)] * k, [c.shape[1] for c in chunks], [heads[0], *[None] * (k - 1)], [heads[1], *[None] * (k - 1)], [c.tobytes() for c in chunks]]
            kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["block", "k", *BLOCK])

        for batch in batches:
            for i, label, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(i)
                labels.append(label)
                vectors.append(v)
                if len(ids) == size:
                    yield full()
                    ids, labels, vectors, at = [], [], [], at + 1
        if ids:
            yield full()

    return rows.mapInArrow(pack, "block long, k int, n int, w int, ids binary, labels binary, x binary")


def grid(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of blocks of the same cell: anchor blocks (a...) and row blocks (r...) of the same chunk."""
    spark = rows.sparkSession
    i, j = (t.filter("k = 0").count() for t in (anchors, rows))
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, min(j, cells))
    down = max(1, min(i, -(-cells // across)))

    def side(t: DataFrame, tag: str, own: str, mine: int, other: str, others: int) -> DataFrame:
        cols = [F.col(c).alias(f"{tag}{c}") for c in ("block", *BLOCK)]
        return t.select("k", F.pmod(F.xxhash64("block"), F.lit(mine)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other), *cols)

    left, right = side(anchors, "a", "i", down, "j", across), side(rows, "r", "j", across, "i", down)
    return left.join(right, ["i", "j", "k"]).select("k", *[f"{t}{c}" for t in "ar" for c in ("block", *BLOCK)])


def tiles(pairs: DataFrame) -> DataFrame:
    """Partial tiles: (ablock, rblock, place, k, part, and with place -1 the tile's rows and anchors)."""
    names = ["ablock", "rblock", "place", "k", "part", "aids", "alabels", "rids", "rlabels"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def multiply(batches):
        for batch in batches:
            for k, ablock, an, aw, aids, alabels, ax, rblock, rn, rw, rids, rlabels, rx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = min(aw, rw)
                a, r = integers(ax, an * aw).reshape(an, aw)[:, :w], integers(rx, rn * rw).reshape(rn, rw)[:, :w]
                exact = w * max(1, int(np.abs(a.astype(np.float64)).max())) * max(1, int(np.abs(r.astype(np.float64)).max())) < 1 << 53
                kind = np.float64 if exact else np.int64
                part = (a.astype(kind) @ r.T.astype(kind)).astype(np.int64)
                out = [(ablock, rblock, i, k, narrow(part[i]).tobytes(), None, None, None, None) for i in range(an)]
                if k == 0:
                    out.append((ablock, rblock, -1, k, None, aids, alabels, rids, rlabels))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return pairs.mapInArrow(multiply, "ablock long, rblock long, place int, k int, part binary, aids binary, alabels binary, rids binary, rlabels binary")


def candidates(strips: DataFrame, positives: int, low: int, high: int) -> DataFrame:
    """For each tile and anchor: its first positives, and the negatives that a window may hold, both in order."""
    rows = strips.repartition("ablock", "rblock").sortWithinPartitions("ablock", "rblock", "place", "k")
    names = ["ablock", "place", "anchor_id", "pos_score", "pos_id", "neg_score", "neg_id"]

    def first(batches):
        head, total, place, ablock, out = None, None, None, None, []

        def chosen():
            aids, alabels, ids, labels = head
            same = (labels == alabels[place]) & (ids != aids[place])
            pick = np.flatnonzero(same)
            if len(pick) > positives:
                pick = pick[total[pick] >= np.partition(total[pick], -positives)[-positives]]
            pick = pick[np.lexsort((ids[pick], -total[pick]))][:positives]
            least = -(-low * max(0, int(total[pick[-1]])) // high) if len(pick) == positives else 0
            left = np.flatnonzero((labels != alabels[place]) & (total >= least) & (ids != aids[place]))
            left = left[np.lexsort((ids[left], -total[left]))]
            return ablock, place, int(aids[place]), total[pick], ids[pick], total[left], ids[left]

        def batch_of(rows):
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for a, at, part, *rest in zip(*(batch.column(c).to_pylist() for c in (0, 2, 4, 5, 6, 7, 8)), strict=True):
                if place is not None and (at != place or at == -1):
                    out.append(chosen())
                    place = None
                    if len(out) == 128:
                        yield batch_of(out)
                        out = []
                if at == -1:
                    head = [np.frombuffer(x, np.int64) for x in rest]
                    continue
                if place is None:
                    place, ablock, total = at, a, np.zeros(len(head[2]), np.int64)
                total += integers(part, len(total))
        if place is not None:
            out.append(chosen())
        if out:
            yield batch_of(out)

    lists = ", ".join(f"{c} array<long>" for c in names[3:])
    return rows.mapInArrow(first, f"ablock long, place int, anchor_id long, {lists}")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see above.

    ``rows`` has vec_id, label and embedding; ``anchor`` is a condition on vec_id. Of the rows of other labels a window holds those
    with ``low * positive_score <= high * negative_score <= high * positive_score``.
    """
    bytes_per_batch(rows.sparkSession)
    named = rows.select("vec_id", "label", "embedding")
    own = named.filter(anchor)
    blocks = materialize(packed(quantised(named, scale), ROWS), "rows")
    n = own.count()
    anchors = materialize(packed(quantised(own, scale).repartition(n // ANCHORS + 1, "vec_id"), ANCHORS), "anchors")
    found = materialize(candidates(tiles(grid(anchors, blocks)), positives, low, high), "candidates")
    key = ["ablock", "place", "anchor_id"]
    each = found.select(*key, F.explode(F.arrays_zip("pos_score", "pos_id")).alias("p")).select(*key, "p.pos_score", "p.pos_id")
    order = Window.partitionBy(*key).orderBy(F.desc("pos_score"), "pos_id")
    best = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= positives)
    best = best.groupBy(*key).agg(F.collect_list(F.struct("at", "pos_score", "pos_id")).alias("best"))
    near = found.filter(F.size("neg_id") > 0).select(*key, F.arrays_zip(F.col("neg_score").alias("s"), F.col("neg_id").alias("id")).alias("near"))
    pairs = near.join(best, key).select(*key, "near", F.explode("best").alias("p"))
    over = F.pmod(F.col("p.pos_score"), F.lit(high))  # low * score / high, rounded up, without large products
    pairs = pairs.withColumn("least", low * F.expr(f"(p.pos_score - pmod(p.pos_score, {high})) div {high}") + F.ceil(low * over / high).cast("long"))

    def inside(x: Column) -> Column:
        return (x["s"] <= F.col("p.pos_score")) & (x["s"] >= F.col("least"))

    held = pairs.select(*key, F.col("p.at").alias("at"), F.col("p.pos_id").alias("positive_id"), F.col("p.pos_score").alias("positive_score"), F.explode(F.slice(F.filter("near", inside), 1, negatives)).alias("x"))
    window = Window.partitionBy(*key, "at", "positive_id", "positive_score").orderBy(F.desc("x.s"), "x.id")
    out = held.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("x.id").alias("negative_id"), "positive_score", F.col("x.s").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The labels of the query: those of every seventh id go on by one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def hard_negatives(rows: DataFrame) -> DataFrame:
    return mine(relabelled(rows), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH e AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS other, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
best AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT b.anchor_id, b.other AS positive_id, row_number() OVER (PARTITION BY b.anchor_id, b.other ORDER BY n.score DESC, n.other)::INTEGER AS "rank",
  n.other AS negative_id, b.score AS positive_score, n.score AS negative_score
FROM best b JOIN scores n ON n.anchor_id = b.anchor_id AND NOT n.same AND 100 * n.score <= 100 * b.score AND 100 * n.score >= 80 * b.score
QUALIFY row_number() OVER (PARTITION BY b.anchor_id, b.other ORDER BY n.score DESC, n.other) <= 5
"""
