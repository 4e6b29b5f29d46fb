r"""Target-distribution importance resampling over hashed word runs.

Features of a text are all its runs of 1 to ``longest`` words; a feature's bucket is its crc32 modulo ``buckets``. A
bucket's gain compares its share of the target texts with its share of the documents, a document's weight is the mean gain of
its features, and a tenth of the eligible documents is drawn by weight with Gumbel noise that only depends on their ids.

1. Tasks write inverted postings (bucket, document, count), packed by block of documents and group of buckets.
2. Counts by bucket of both corpora are co-grouped, and each bucket's gain is computed where its counts meet.
3. Postings are shuffled by group of buckets to their gains. Every group is dealt out over ``SALTS`` places by block: a
   document has one posting for a bucket at most, so that no bucket, however frequent, weighs more than its group.
4. Tasks emit one contribution for each document and group; they are reduced by block of documents.
5. Scored documents are range-partitioned in the order of the draw; a document's rank is its place in its partition behind the
   rows of the partitions before it.

Defined results: a null text has no words and no features, weight 0, and isn't eligible; the empty table gives no
rows; an empty target has T = 0, so that gains compare with even shares; repeated rows count and are drawn each for itself, rows
of equal score and id follow each other by n_features and weight; a row without an id counts as text, has no score and
is never drawn; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, materialize, small_batches

#: Bytes outside the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become blanks.
WORD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
#: Groups of buckets, and places that each of them is dealt out to.
GROUPS, SALTS = 16, 64
#: Postings and documents after which a block ends.
BLOCK_POSTINGS, BLOCK_ROWS = 1 << 16, 1 << 12
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


@lru_cache(1 << 17)
def crc(feature: bytes) -> int:
    return zlib.crc32(feature)


def features(text: bytes | None, longest: int = 1) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of words."""
    text, found, n, at, carried = (text or b"").lower().translate(WORD), Counter(), 0, 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        words = text[at : end if end >= 0 else len(text)].split()
        found.update(words)
        n += len(words)
        for k in range(2, longest + 1):  # runs that end in this piece
            have = carried[-(k - 1) :] + words
            found.update(b" ".join(have[i : i + k]) for i in range(len(have) - k + 1))
        carried = (carried + words)[-(longest - 1) :] if longest > 1 else []
        at = end if end >= 0 else len(text)
    return found, n


def postings(texts: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """Packed postings of (doc_id, text): block, grp, and for each posting its document's place in the block, bucket and count.

    The row of group -1 has the block's ids, and their numbers of features and of words.
    """
    key = texts.schema["doc_id"].dataType
    schema = f"block long, grp int, at binary, bucket binary, n binary, ids array<{key.simpleString()}>, n_features array<long>, n_words array<long>"

    def pack(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        ids, kind = [], pa.list_(to_arrow_type(key))
        sizes, words, places, where, counts = [], [], [], [], []
        held, block = 0, TaskContext.get().partitionId() << 32

        def full():
            at = np.repeat(np.arange(len(ids), dtype=np.uint16), places)
            bucket, n = np.array(where, np.int64), np.array(counts, np.int64)
            groups, rows = bucket % GROUPS, [(block, -1, b"", b"", b"", ids, sizes, words)]
            for g in np.unique(groups):
                own = groups == g
                rows.append((block, int(g), at[own].tobytes(), bucket[own].tobytes() if buckets > 1 << 16 else bucket[own].astype(np.uint16).tobytes(), n[own].astype(np.uint32).tobytes(), None, None, None))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), kind, pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["block", "grp", "at", "bucket", "n", "ids", "n_features", "n_words"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                found, n = features(text, longest)
                mine: dict[int, int] = {}
                for feature, k in found.items():
                    b = crc(feature) % buckets
                    mine[b] = mine.get(b, 0) + k
                ids.append(doc)
                sizes.append(sum(mine.values()))
                words.append(n)
                places.append(len(mine))
                where += mine.keys()
                counts += mine.values()
                held += len(mine)
                if held >= BLOCK_POSTINGS or len(ids) == BLOCK_ROWS:
                    yield full()
                    ids, sizes, words, places, where, counts = [], [], [], [], [], []
                    held, block = 0, block + 1
        if ids:
            yield full()

    return texts.select("doc_id", "text").mapInArrow(pack, schema)


def _bucket_type(buckets: int):
    return np.int64 if buckets > 1 << 16 else np.uint16


def bucket_counts(posted: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): sums of postings, first within each task."""

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(bucket, _bucket_type(buckets)), np.frombuffer(n, np.uint32).astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return posted.filter("grp >= 0").select("bucket", "n").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) from the counts ``s`` of the documents and ``t`` of the target, co-grouped by bucket."""
    both = source.select("bucket", "s", F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), "t"))
    both = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    (s,), (t,) = source.agg(F.coalesce(F.sum("s"), F.lit(0))).first(), target.agg(F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def contributions(posted: DataFrame, gain: DataFrame, buckets: int) -> DataFrame:
    """(block, grp, at, part): for each document of a block what a group of buckets adds to its sum of gains."""
    packed = gain.groupBy((F.col("bucket") % GROUPS).cast("int").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("bucket", "gain"))).alias("g"))
    packed = packed.select("grp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("g.bucket").alias("gb"), F.col("g.gain").alias("gg"))
    rows = posted.filter("grp >= 0").select("block", "grp", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"), "at", "bucket", "n")
    # The gains are few enough to be broadcast; the method here is to shuffle the postings to them.
    met = rows.join(packed.hint("merge"), ["grp", "salt"]).select("block", "grp", "at", "bucket", "n", "gb", "gg")

    def emit(batches):
        for batch in batches:
            blocks, groups, ats, where, ns = (batch.column(i).to_pylist() for i in range(5))
            out, known = [], {}
            for i, (at, b, n) in enumerate(zip(ats, where, ns, strict=True)):
                if groups[i] not in known:
                    known[groups[i]] = (batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy())
                gb, gg = known[groups[i]]
                at = np.frombuffer(at, np.uint16)
                each = gg[np.searchsorted(gb, np.frombuffer(b, _bucket_type(buckets)))] * np.frombuffer(n, np.uint32).astype(np.int64)
                first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
                out.append((at[first].tobytes(), np.add.reduceat(each, first).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(groups, pa.int32()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["block", "grp", "at", "part"])

    return met.mapInArrow(emit, "block long, grp int, at binary, part binary")


def weights(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, n_features, n_words, weight): contributions reduced by document, a block after the other."""
    key = posted.schema["ids"].dataType.elementType
    none = [F.lit(None).cast(posted.schema[c].dataType).alias(c) for c in ("ids", "n_features", "n_words")]
    heads = posted.filter("grp = -1").select("block", "grp", "at", F.lit(b"").alias("part"), "ids", "n_features", "n_words")
    rows = heads.unionByName(parts.select("*", *none)).repartition("block").sortWithinPartitions("block", "grp")

    def reduce(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind, head, total = to_arrow_type(key), None, None

        def done():
            ids, n, words = head
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            return pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(n), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

        for batch in batches:
            for i, (g, at, part) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if g == -1:
                    if head is not None:
                        yield done()
                    head = (batch.column(4)[i].values, batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy())
                    total = np.zeros(len(head[1]), np.int64)
                else:
                    total[np.frombuffer(at, np.uint16)] += np.frombuffer(part, np.int64)
        if head is not None:
            yield done()

    return rows.mapInArrow(reduce, f"doc_id {key.simpleString()}, n_features long, n_words long, weight long")


def draw(weighed: DataFrame, share: int, least: int, seed: str) -> DataFrame:
    """Adds score and rank; the order is that of a range exchange, whose partitions are numbered in it."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    scored = scored.withColumn("out", F.when((F.col("n_words") >= least) & F.col("score").isNotNull(), 0).otherwise(1))
    order = [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    part = F.shiftright("place", 33).cast("int")
    each = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum(1 - F.col("out")).alias("able"))
    (n,) = each.agg(F.coalesce(F.sum("able"), F.lit(0))).first()
    before = each.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row for each partition
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(before, "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when((F.col("out") == 0) & (rank <= share * n // 100), rank).alias("rank"), "n_words")


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024") -> DataFrame:
    """Every document's n_features, weight, score and rank in the draw of ``share`` per cent of those with ``least`` words.

    ``docs`` needs doc_id and text, ``target`` text.
    """
    small_batches(docs.sparkSession)
    posted = materialize(postings(docs, buckets, longest), "postings")
    aims = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    gain = gains(bucket_counts(posted, buckets, "s"), bucket_counts(aims, buckets, "t"), buckets)
    return draw(weights(posted, contributions(posted, gain, buckets)), share, least, seed)


def digests(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH words AS MATERIALIZED (
  SELECT uid, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS uid, 's' AS side, text FROM documents UNION ALL SELECT -row_number() OVER (), 't', text FROM benchmark)),
bytes AS (SELECT w, string_split(hex(encode(w)), '') AS x FROM (SELECT DISTINCT w FROM words)),
named AS MATERIALIZED (SELECT w, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(x), 2), lambda i: [16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 10000 AS bucket FROM bytes),
counts AS MATERIALIZED (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN named USING (w) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, total),
each AS (SELECT uid, count(*) AS n, sum(gain)::BIGINT AS g FROM words JOIN named USING (w) JOIN gains USING (bucket) WHERE side = 's' GROUP BY uid),
docs AS (SELECT row_number() OVER () AS uid, doc_id FROM documents),
noise AS (SELECT doc_id, (strpos('0123456789abcdef', h[1]) - 1) * 268435456 + (strpos('0123456789abcdef', h[2]) - 1) * 16777216 + (strpos('0123456789abcdef', h[3]) - 1) * 1048576
    + (strpos('0123456789abcdef', h[4]) - 1) * 65536 + (strpos('0123456789abcdef', h[5]) - 1) * 4096 + (strpos('0123456789abcdef', h[6]) - 1) * 256
    + (strpos('0123456789abcdef', h[7]) - 1) * 16 + strpos('0123456789abcdef', h[8]) - 1 AS h
  FROM (SELECT DISTINCT doc_id, sha256('2024:' || doc_id::VARCHAR) AS h FROM documents)),
scored AS (SELECT uid, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    (CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN each USING (uid) LEFT JOIN noise USING (doc_id)),
ranked AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 10 * able // 100 THEN r END::BIGINT AS "rank"
FROM scored LEFT JOIN ranked USING (uid)
"""
