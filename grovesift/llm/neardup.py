r"""Near-duplicate groups with HyperMinHash registers.

A document's set holds its distinct runs of ``K`` words (``[^\x20\x09-\x0D]+`` with A-Z lower-cased). For each
of ``BANDS * ROWS`` buckets the least hash of the set is kept as one byte: its count of leading zeros (5 bits)
and the bits behind the leading one (3). Bands of ``ROWS`` registers are the keys under which candidates meet.
A pair of similarity 0.75 shares no band with a probability of (1 - 0.75**6)**64, under 4 in a million.

1. Equal sets, by a cryptographic digest of the full set, are one class, represented by its smallest id; only
   representatives go on.
2. In each bucket every member is a candidate of the smallest one (a star, not all pairs). Candidates whose
   Jaccard estimate, corrected for registers that agree by chance, is clearly too low are dropped; the full sets
   of the others are compared.
3. Connected components of these links.
4. Buckets that still hold several components are compared on, on the full sets, in blocks of ``BLOCK`` rows
   by ``BLOCK`` rows, as products of incidence matrices; of the links found, a spanning forest goes on. Blocks are made
   by set size, and meet only where sizes allow a link; the members of a bucket's largest component meet the others but
   not each other. So no link between members of a bucket is lost, and no list of pairs is ever made.
5. Components again, over the links of both rounds.

Full sets are made for members of buckets only: texts meet these ids in a shuffled join. Only a bucket with very many members that are alike, but under the threshold, costs the square of their number.

Defined results: a null or empty text has an empty set and is its own component; rows that share an id are one
document to its links (each row's set is tested), and repeated rows keep their rows; a row of a null id is
linked with nothing, its component is null and it is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop
from .common import binary, blocks, materialize, mix, shingles, words_of

K, PERCENT = 5, 75
ROWS, BANDS = 6, 64
SIZE = ROWS * BANDS
#: Standard errors of the estimate by which a candidate may miss the threshold before it is dropped.
SLACK = 5.5
BLOCK = 512
#: Bytes of sets in a block, so that long documents make blocks of fewer rows.
BLOCK_BYTES = 1 << 24
#: Sets whose sizes differ by at most this factor (a trifle over 4/3) are in the same class of sizes or in neighbouring ones.
CLASS = 4 / 3 * 1.0001
_rng = np.random.default_rng(20)
FACTOR = (_rng.integers(0, 1 << 32, SIZE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFT = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint64).astype(np.uint32)
POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    """The compressed registers of a set of 64-bit hashes (not empty)."""
    x = s.astype(np.uint32)
    least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * FACTOR + SHIFT).min(axis=0), out=least)
    wide = least.astype(np.float64) * 8 + 4  # exact in a double; 4 keeps the logarithm defined
    zeros = np.clip(34 - np.floor(np.log2(wide)).astype(np.int64), 0, 31)
    lead = np.left_shift(least.astype(np.uint64), (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (zeros << 3 | (lead >> np.uint64(29)).astype(np.int64)).astype(np.uint8)


def band_keys(r: np.ndarray) -> np.ndarray:
    """Keys of the bands of many documents' registers, a row for each document."""
    parts = r.reshape(len(r), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((parts * POWER).sum(axis=2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.arange(BANDS, dtype=np.uint64))


def agreement_by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m elements agree: equal zeros, and then equal bits."""
    z = np.arange(32)
    low, high = 1 - 2.0**-z, 1 - 2.0 ** -(z + 1)
    share = lambda k: high ** np.asarray(k, float)[:, None] - low ** np.asarray(k, float)[:, None]
    return (share(n) * share(m)).sum(axis=1) / 8


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows a and b of sets of n and m elements, corrected for agreement by chance."""
    chance = agreement_by_chance(n, m)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def sets_of(texts: list[bytes | None]):
    """The sorted set of each text."""
    for first, end in blocks(texts):
        h, a, b = words_of(texts[first:end])
        for i, j in zip(a, b, strict=True):
            yield np.unique(shingles(h[i:j], K))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, r): set size, a 128-bit fingerprint of the set, and registers.

    Registers are given for a set's first row in a task, and again for rows of smaller ids, so that the row of the
    smallest id has them while thousands of copies don't.
    """

    def make(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, out = part.column(0).to_pylist(), ([], [], [], [])
                for doc_id, s in zip(ids, sets_of(binary(part.column(1))), strict=True):
                    f = struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    r = None
                    if len(s) and doc_id is not None and doc_id < seen.get(f, 1 << 63):
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[f] = doc_id
                        r = registers(s).tobytes()
                    for column, v in zip(out, (len(s), *f, r), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n", "f1", "f2", "r"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, f1 long, f2 long, r binary")


def bands(representatives: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each representative (id, r)."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                r = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SIZE)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(r).ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "id"])

    return representatives.select("id", "r").mapInArrow(make, "key long, id long")


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(id, s): the sets, as bytes of sorted 64-bit hashes, of the documents whose ids are wanted (id, each once).

    Texts are shuffled to the ids at every size: a broadcast of few ids would be another plan for small tables. Where rows
    share ids (``repeated``), each of an id's sets is kept once.
    """

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [s.tobytes() for s in sets_of(binary(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "s"])

    with_id = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    if repeated:  # equal rows first, within a task too
        with_id = with_id.groupBy("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text")).agg(F.first("text").alias("text")).select("id", "text")
    out = with_id.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(make, "id long, s binary")
    return out.groupBy("id", F.sha2("s", 256).alias("_set")).agg(F.first("s").alias("s")).select("id", "s") if repeated else out


def both_ends(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Edges (a, b, ...) with the value (id, value) of either end, as value_a and value_b."""
    for end in "ab":
        edges = edges.join(values.select(F.col("id").alias(end), F.col(value).alias(f"{value}_{end}")), end)
    return edges


def likely(candidates: DataFrame, representatives: DataFrame) -> DataFrame:
    """The candidates (a, b) whose estimate isn't clearly under the threshold."""
    info = representatives.select("id", F.struct("n", "r").alias("v"))
    met = both_ends(candidates, info, "v").select("a", "b", "v_a.n", "v_a.r", F.col("v_b.n").alias("n2"), F.col("v_b.r").alias("r2"))
    goal = PERCENT / 100
    least = goal - SLACK * np.sqrt(goal * (1 - goal) / SIZE)

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("r", "r2"))
                n, m = (part.column(c).to_numpy() for c in ("n", "n2"))
                ok = (estimate(x, y, n, m) >= least) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return met.mapInArrow(keep, "a long, b long")


def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) whose full sets are similar enough."""

    def keep(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both_ends(candidates, sets, "s").select("a", "b", "s_a", "s_b").mapInArrow(keep, "a long, b long")


def forest(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets, from the left block to the right or within one block; links within a label are known.

    Sizes of intersections are sums of products of incidence matrices over the elements that two sets share at least.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.concatenate([edge, [len(flat)]]))
    element = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    element, owner = element[shared], owner[shared]
    both = np.zeros((n, n), np.float32)
    cut = np.searchsorted(element, np.arange(0, (element[-1] if len(element) else -1) + 2048, 2048)) if len(element) else [0]
    for i, j in zip(cut, [*cut[1:], len(element)], strict=False):
        if j > i:
            m = np.zeros((n, int(element[j - 1] - element[i]) + 1), np.float32)
            m[owner[i:j], element[i:j] - element[i]] = 1
            both += m @ m.T
    links = (100 * both >= PERCENT * (size[:, None] + size - both)) & (labels[:, None] != labels) & (both > 0)
    if left.any() and not left.all():
        links &= left[:, None] & ~left
    root = {v: v for v in labels.tolist()}

    def find(v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        x, y = find(int(labels[i])), find(int(labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def across(band: DataFrame, sizes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket of ``band`` (key, id): pairs that sizes allow are compared, block by block."""
    named = band.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = materialize(named.join(sizes.select("id", "n"), "id").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS))).cast("int")), "named")
    held = named.groupBy("key", "label").agg(F.count("*").alias("held"), F.sum("n").alias("size"))
    mixed = held.groupBy("key").agg(F.max_by("label", F.struct("held", -F.col("label"))).alias("largest"), F.count("*").alias("components"), F.sum("held").alias("members"), F.sum("size").alias("size")).filter("components > 1")
    # A bucket of at most a block's size is one block; in others the members of the largest component are a side of their own.
    whole = (F.col("members") <= BLOCK) & (F.col("size") * 8 <= BLOCK_BYTES)
    rows = named.join(mixed.select("key", "largest", "members", "size"), "key").withColumns({"side": F.when(whole, 1).otherwise((F.col("label") != F.col("largest")).cast("int")), "class": F.when(whole, 0).otherwise(F.col("class"))})
    rows = materialize(rows.drop("largest", "members", "size"), "mixed")
    # The blocks of each bucket: for each class of sizes and side how many there are.
    counts = rows.groupBy("key", "class", "side").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    blocks_ = counts.groupBy("key").agg(F.collect_list(F.struct("class", "side", "n_blocks")).alias("blocks"))
    code = lambda kind, side, b: (kind * 2 + side).cast("long") * (1 << 32) + b
    of_own = F.filter("blocks", lambda x: (x["class"] == F.col("class")) & (x["side"] == F.col("side")))[0]["n_blocks"]
    own = code(F.col("class"), F.col("side"), F.pmod(F.xxhash64("id", F.lit(7)), of_own))
    fits = F.filter("blocks", lambda x: (F.abs(x["class"] - F.col("class")) <= 1) & ((x["side"] == 1) | (F.col("side") == 1)))
    others = F.flatten(F.transform(fits, lambda x: F.transform(F.sequence(F.lit(0), x["n_blocks"] - 1), lambda b: code(x["class"], x["side"], b))))
    placed = rows.join(blocks_, "key").withColumns({"own": own}).withColumn("other", F.explode(others))
    placed = placed.select("id", "label", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("left"))

    def compare(group: pa.Table) -> pa.Table:
        ids, labels, left = (group.column(c).to_numpy() for c in ("id", "label", "left"))
        out = []
        if len(set(labels.tolist())) > 1:
            out = forest(ids, [np.frombuffer(s, np.uint64) for s in group.column("s").to_pylist()], labels, left)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    out = materialize(placed.join(sets, "id").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "across")
    drop(named, rows)
    return out


def components(edges: DataFrame) -> DataFrame | None:
    """(id, label): the smallest id reachable from each id in the edges (a < b); None without edges.

    In each round ids take the smallest label next to them, labels are followed twice, and edges are drawn anew
    between labels; an edge within a label is done. Everything stays distributed; each round is a written table.
    """
    found = None
    edges = materialize(edges.distinct(), "edges")
    while not edges.isEmpty():
        either = edges.union(edges.select("b", "a")).toDF("id", "near")
        steps = [materialize(either.groupBy("id").agg(F.least("id", F.min("near")).alias("label")), "low")]
        for _ in range(2):
            ahead = steps[-1].select(F.col("id").alias("label"), F.col("label").alias("further"))
            steps.append(materialize(steps[-1].join(ahead, "label").select("id", F.col("further").alias("label")), "low"))
        low, before = steps.pop(), found
        if found is None:
            found = materialize(low, "found")
        else:
            ahead = low.select(F.col("id").alias("label"), F.col("label").alias("further"))
            found = materialize(found.join(ahead, "label", "left").select("id", F.coalesce("further", "label").alias("label")), "found")
        to = low.select(F.col("id").alias("a"), F.col("label").alias("x")), low.select(F.col("id").alias("b"), F.col("label").alias("y"))
        ends = edges.join(to[0], "a").join(to[1], "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        done, edges = edges, materialize(ends.distinct(), "edges")
        drop(done, low, *steps, *([before] if before is not None else []))
    drop(edges)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    made = materialize(features(docs), "features")
    real = made.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), "classes")
    firsts = classes.select("f1", "f2", "id")
    reps = materialize(
        real.filter(F.col("r").isNotNull()).withColumnRenamed("doc_id", "id").join(firsts, ["f1", "f2", "id"]).select("id", "n", "r").dropDuplicates(["id", "n", "r"]), "reps"
    )
    band = materialize(bands(reps), "bands")
    centers = materialize(band.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("members")).filter("members > 1"), "centers")
    members = materialize(band.join(centers.select("key", "a"), "key"), "members")
    drop(band)
    stars = members.filter("a != id").select("a", F.col("id").alias("b")).distinct()
    likely_ = materialize(likely(stars, reps), "likely")
    repeated = not made.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    sets = materialize(full_sets(docs, members.select("id").distinct(), repeated), "sets")
    links = materialize(verified(likely_, sets), "links")
    found = components(links)
    if found is not None or not centers.isEmpty():
        labels = found if found is not None else members.select("id", F.col("id").alias("label")).limit(0)
        more, before = across(members.select("key", "id"), reps.select("id", "n").distinct(), labels, sets), found
        found = components(links.union(more))
        drop(more, *([before] if before is not None else []))
    if found is not None:
        named = materialize(classes.join(found, "id", "left").select("f1", "f2", F.coalesce("label", "id").alias("component_id")), "named")
        drop(found, classes)
    else:
        named = classes.withColumnRenamed("id", "component_id")
    drop(reps, centers, members, likely_, sets, links)
    joined = made.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS uid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT uid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM docs),
sets AS MATERIALIZED (SELECT doc_id, s, len(s) AS n FROM cut WHERE len(s) > 0 AND doc_id IS NOT NULL),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, list_sort(s) AS s, n FROM sets GROUP BY list_sort(s), n),
runs AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM classes),
met AS (SELECT a.id AS x, b.id AS y, a.n AS m, b.n AS n, count(*) AS shared FROM runs a JOIN runs b ON a.g = b.g AND (a.id, a.n) < (b.id, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM met WHERE 100 * shared >= 75 * (m + n - shared)
  UNION SELECT DISTINCT c.id, s.doc_id FROM sets s JOIN classes c ON list_sort(s.s) = c.s AND s.doc_id <> c.id),
either AS MATERIALIZED (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM sets UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, len(c.s)::BIGINT AS n_shingles, CASE WHEN len(c.s) > 0 THEN l.component_id ELSE c.doc_id END AS component_id,
  coalesce(c.doc_id = CASE WHEN len(c.s) > 0 THEN l.component_id ELSE c.doc_id END, true) AS kept
FROM cut c LEFT JOIN least_ l USING (doc_id)
"""
