r"""Repeated substrings by sorted suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts in a document of a smaller id is removed.

Not every suffix is kept: all of them would be fifty times the input. A window of ``LENGTH`` bytes is charged to the
least-hashed ``GRAM``-byte string within it, its anchor; equal windows have equal anchors, and neighbouring windows
mostly share theirs, so that there is one anchor for some 16 bytes. What is charged to an anchor in a row (a run) is
a suffix from the anchor on, and the bytes before it.

1. For each run its anchor's hash and a digest of the run's bytes are shuffled, packed by task. A run whose digest stands
   in a document of a smaller id is removed whole. Of the others those go on whose anchor has several digests.
2. These suffixes are range-partitioned by sampled splitters over their bytes from the anchor on, then those
   before it. Each bucket sorts its suffixes, and what precedes them read backwards, by multikey quicksort over 8-byte
   symbols. Common prefixes of neighbours in both orders tell which windows are equal.
3. Across the borders of buckets: a window whose part from the anchor on begins a splitter may have equals in
   another bucket. Such windows meet by their bytes, with partial minima, so that no text however frequent is the
   burden of a single task.

An anchor that a bounded sample of documents shows to be frequent is dealt out by digest instead of by anchor. Digests are
sums of products with random keys, drawn for each call: texts can't be made to collide.

Defined results: a null text is empty; rows that share an id never remove from each other; a row of a null id is
left whole and removes nothing elsewhere; repeated rows keep their rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, materialize, mix, powers, release

LENGTH, GRAM = 50, 20
#: The largest number of bytes before an anchor.
BEFORE = LENGTH - GRAM
#: Bytes that are hashed at once; longer texts are cut into overlapping parts.
PART = 1 << 18
LOW = np.uint64((1 << 48) - 1)
#: Bytes and documents of which runs are packed at once.
SLICE, SLICE_ROWS = 1 << 22, 60_000
#: Bytes of text for one bucket of anchors, and buckets at least.
BUCKET_BYTES, BUCKETS = 1 << 22, 16
#: Partitions at most; a task handles its buckets one after the other.
PARTITIONS = 20_000
#: Suffixes in a bucket that is sorted, and sampled ones for each splitter.
SUFFIXES, OVERSAMPLE = 16_384, 8
#: Documents in the sample that shows frequent anchors, and in how many of these such an anchor stands.
SAMPLE_DOCS, FREQUENT = 4000, 4
#: Digests at frequent anchors that a task remembers, at most.
MOST_SEEN = 1 << 18
#: Parts of a bucket that are sorted by all their symbols at once.
SMALL = 512
WORDS = (LENGTH + BEFORE) // 4


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    n = len(buf) - k + 1
    return mix((sums[k:] - sums[:-k]) * down[:n])


def parts(texts: list[bytes], most: int = PART):
    """(document numbers, offsets, buffer, starts in it): documents side by side; long ones in parts that overlap by a window less one byte."""
    number, offset, start, held, size = [], [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), most - LENGTH + 1):
            piece = t[at : at + most]
            if size + len(piece) > 2 * most and held:
                yield np.array(number), np.array(offset), np.frombuffer(b"".join(held), np.uint8), np.array(start)
                number, offset, start, held, size = [], [], [], [], 0
            number.append(k)
            offset.append(at)
            start.append(size)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(number), np.array(offset), np.frombuffer(b"".join(held), np.uint8), np.array(start)


def runs(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: part, first and last window, anchor, and the anchor's hash."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = rolling(buf, GRAM)
    low = (1 << 20) - 1
    best = (h & np.uint64(~low & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[:n], best[want - width : want - width + n])
    anchor = (best[:n] & np.uint64(low)).astype(np.int64)
    part = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(buf))))[:n]
    ends = np.append(start[1:], len(buf))
    inside = np.flatnonzero(np.arange(n) + LENGTH <= ends[part])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    a, p = anchor[inside], part[inside]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])]))
    last = np.append(new[1:], len(inside)) - 1
    return p[new], inside[new], inside[last], a[new], h[a[new]]


def random_keys() -> np.ndarray:
    """Two rows of keys of a digest: one key for each 4 bytes of a run, one for its shape, and one that is added."""
    return np.frombuffer(os.urandom(16 * (WORDS + 2)), np.uint64).reshape(2, -1)


def run_digests(buf: np.ndarray, first: np.ndarray, size: np.ndarray, off: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit digests of runs (first byte, size, anchor's place): the upper halves of two sums of 32-bit words times keys."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    shape = (size * 64 + off).astype(np.uint64)
    sums = [k[WORDS] * shape + k[WORDS + 1] for k in keys]
    for j in range(0, WORDS, 2):
        left = size - 4 * j
        w = words[np.minimum(first + 4 * j, len(buf))] & keep[np.clip(left, 0, 8)]
        low, high = w & np.uint64(0xFFFFFFFF), w >> np.uint64(32)
        for s, k in zip(sums, keys, strict=True):
            s += low * k[j]
            s += high * k[j + 1]
    return (sums[0] & np.uint64(0xFFFFFFFF00000000)) | (sums[1] >> np.uint64(32))


def edges(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are sorted together."""
    n = len(sorted_columns[0])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for c in sorted_columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def smallest(group_start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each member of consecutive groups the smallest value of its group."""
    if not len(values):
        return values
    return np.repeat(np.minimum.reduceat(values, group_start), np.diff(np.append(group_start, len(values))))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def slices(batches):
    """(ids, keys, texts) of documents that have a window, of about ``SLICE`` bytes."""
    ids, keys, texts, held = [], [], [], 0
    for batch in batches:
        for doc_id, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
            if len(t) < LENGTH:
                continue
            ids.append(doc_id)
            keys.append(key)
            texts.append(t)
            held += len(t)
            if held >= SLICE or len(texts) >= SLICE_ROWS:
                yield np.array(ids, np.int64), np.array(keys, np.int64), texts
                ids, keys, texts, held = [], [], [], 0
    if texts:
        yield np.array(ids, np.int64), np.array(keys, np.int64), texts


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """The hashes of anchors that many documents of a bounded sample hold, sorted."""
    h = F.xxhash64("doc_id", F.lit(3))
    cut = docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return np.zeros(0, np.uint64)

    def count(batches):
        for _, _, texts in slices(batches):
            own = [np.unique(number[p].astype(np.uint64) << np.uint64(48) | (x & LOW)) for number, _, buf, start in parts(texts) for p, _, _, _, x in [runs(buf, start)]]
            found, n = np.unique(np.concatenate(own) & LOW, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    seen = docs.filter(h <= cut).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(seen.filter(F.col("n") >= FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64).astype(np.uint64))


PACKED = "bucket int, docs binary, owner binary, low binary, high binary, digest binary, start binary, windows binary, off binary"


def pack(bucket: int, docs: np.ndarray, owner: np.ndarray, h: np.ndarray, digest: np.ndarray, start: np.ndarray, windows: np.ndarray, off: np.ndarray) -> tuple:
    own, place = np.unique(owner, return_inverse=True)
    columns = docs[own], place.astype(np.uint16), h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16), digest, start.astype(np.uint32), windows.astype(np.uint32 if bucket < 0 else np.uint8), off.astype(np.uint8)
    return (bucket, *(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(documents as rows of id and key, hash, digest, start, windows, anchor's place) of all packed rows of a bucket."""
    wide = np.uint32 if group.column("bucket")[0].as_py() < 0 else np.uint8
    kinds = {"owner": np.uint16, "low": np.uint32, "high": np.uint16, "digest": np.uint64, "start": np.uint32, "windows": wide, "off": np.uint8}
    raw = {c: [np.frombuffer(x, k) for x in group.column(c).to_pylist()] for c, k in kinds.items()}
    docs = [np.frombuffer(x, np.int64).reshape(-1, 2)[o] for x, o in zip(group.column("docs").to_pylist(), raw["owner"], strict=True)]
    c = {k: np.concatenate(v) for k, v in raw.items()}
    return np.concatenate(docs), c["low"].astype(np.uint64) | c["high"].astype(np.uint64) << np.uint64(32), c["digest"], c["start"].astype(np.int64), c["windows"].astype(np.int64), c["off"].astype(np.int64)


class Seen:
    """Digests of runs at frequent anchors with the smallest id that a task has met, ``MOST_SEEN`` at most; then it begins anew."""

    def __init__(self):
        self.digest, self.low, self.id = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smaller(self, digest: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each run stands under a smaller id."""
        if not len(self.digest):
            return np.zeros(len(ids), bool)
        k = np.minimum(np.searchsorted(self.digest, digest), len(self.digest) - 1)
        return (self.digest[k] == digest) & (self.low[k] == low) & (self.id[k] < ids)

    def add(self, digest: np.ndarray, low: np.ndarray, ids: np.ndarray) -> None:
        digest, low, ids = (np.concatenate(c) for c in ((self.digest, digest), (self.low, low), (self.id, ids)))
        order = np.lexsort((ids, digest))
        first = order[edges(digest[order])]
        if len(first) > MOST_SEEN:
            first = first[:0]
        self.digest, self.low, self.id = digest[first], low[first], ids[first]


def packed_runs(docs: DataFrame, buckets: int, frequent: np.ndarray, keys: np.ndarray) -> DataFrame:
    """The runs of all documents (doc_id, key, text), packed by bucket.

    Runs that stand in the same slice under a smaller id, or at a frequent anchor in an earlier slice of the task, are
    decided here; they go, as merged stretches, to buckets of negative numbers. So a digest, however frequent, sends a
    record for a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, keys))

    def make(batches):
        frequent, keys = shared.value
        spread, seen = 0, Seen()
        for ids, row_keys, texts in slices(batches):
            found = []
            for number, offset, buf, start in parts(texts):
                p, first, last, anchor, h = runs(buf, start)
                found.append((number[p], first - start[p] + offset[p], last - first + 1, anchor - first, h, run_digests(buf, first, last - first + LENGTH, anchor - first, keys)))
            owner, at, windows, off, h, digest = (np.concatenate(c) for c in zip(*found, strict=True))
            low = h & LOW
            order = np.argsort(digest)
            same = edges(digest[order], low[order])
            least = np.empty(len(order), np.int64)
            least[order] = smallest(same, ids[owner[order]])
            done = least < ids[owner]
            often = is_in(frequent, low)
            hot = np.flatnonzero(often & ~done)
            done[hot] = seen.smaller(digest[hot], low[hot], ids[owner[hot]])
            hot = hot[~done[hot]]
            seen.add(digest[hot], low[hot], ids[owner[hot]])
            rows = []
            if done.any():  # still by document and place
                o, a, b = owner[done], at[done], at[done] + windows[done]
                begin = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (a[1:] != b[:-1])]))
                stop = np.append(begin[1:], len(o)) - 1
                spread += 1
                none = np.zeros(len(begin), np.uint64)
                rows.append(pack(-1 - (spread * 7919 + len(o)) % buckets, np.stack([ids, row_keys], 1), o[begin], none, none, a[begin], b[stop] - a[begin], none))
            rest = ~done
            owner, at, windows, off, low, digest, h, often = (c[rest] for c in (owner, at, windows, off, low, digest, h, often))
            bucket = (np.where(often, digest >> np.uint64(20), h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            owner, at, windows, off, low, digest, bucket = (c[order] for c in (owner, at, windows, off, low, digest, bucket))
            begin = edges(bucket)
            for i, j in zip(begin, [*begin[1:], len(bucket)], strict=True):
                rows.append(pack(int(bucket[i]), np.stack([ids, row_keys], 1), owner[i:j], low[i:j], digest[i:j], at[i:j], windows[i:j], off[i:j]))
            for i in range(0, len(rows), 256):
                c = list(zip(*rows[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], [f.split()[0] for f in PACKED.split(", ")])

    return docs.mapInArrow(make, PACKED)


def decided(packed: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, key, start, windows, off): runs that are removed whole (off is -1), and those that must be compared as suffixes."""
    shared = packed.sparkSession.sparkContext.broadcast(frequent)

    def find(group: pa.Table) -> pa.Table:
        docs, h, digest, start, windows, off = unpack(group)
        if group.column("bucket")[0].as_py() < 0:
            off = np.full(len(start), -1)
        else:
            order = np.argsort(digest)
            h, digest, ids = h[order], digest[order], docs[order, 0]
            whole = smallest(edges(digest, h), ids) < ids
            # Of what is first under its digest: anchors that several documents hold, or that are dealt out by digest.
            rest = np.flatnonzero(~whole)
            by_anchor = rest[np.argsort(h[rest], kind="stable")]
            group_start = edges(h[by_anchor])
            several = smallest(group_start, ids[by_anchor]) < -smallest(group_start, -ids[by_anchor])
            go = by_anchor[several | is_in(shared.value, h[by_anchor])]
            state = np.where(whole, -1, -2)
            state[go] = off[order][go]
            chosen = np.flatnonzero(state > -2)
            docs, start, windows, off = docs[order[chosen]], start[order[chosen]], windows[order[chosen]], state[chosen]
        return pa.table({"doc_id": docs[:, 0], "key": docs[:, 1], "start": start, "windows": windows.astype(np.int32), "off": off.astype(np.int32)})

    return packed.repartition(min(2 * buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(find, "doc_id long, key long, start long, windows int, off int")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of binaries without nulls, and where each begins (one more than rows)."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begin


def stretches(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of a buffer as an Arrow column of binaries."""
    ends = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def suffixes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, key, start, off, c): the bytes of the wanted runs."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                buf, begin = flat(part.column(2))
                lists = part.column(3)
                counts = np.diff(np.asarray(lists.offsets))
                row = np.repeat(np.arange(part.num_rows), counts)
                runs_ = lists.flatten()
                start, windows, off = (runs_.field(k).to_numpy() for k in range(3))
                c = stretches(buf, begin[row] + start, windows.astype(np.int64) + LENGTH - 1)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(1).to_numpy()[row]), pa.array(start), pa.array(off), c], ["doc_id", "key", "start", "off", "c"])

    # Repeated rows want the same runs: each of them once, so that rows that repeat cost their number and not its square.
    lists = wanted.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "windows", "off")).alias("runs"))
    return docs.join(lists, ["doc_id", "key"]).select("doc_id", "key", "text", "runs").mapInArrow(make, "doc_id long, key long, start long, off int, c binary")


def sides(buf: np.ndarray, begin: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each suffix its ``LENGTH`` bytes from the anchor on, then those before it backwards; zeros where there are none."""
    anchor, end = begin[:-1] + off, begin[1:]
    on = anchor[:, None] + np.arange(LENGTH)
    back = anchor[:, None] - 1 - np.arange(BEFORE)
    out = np.zeros((len(off), LENGTH + BEFORE), np.uint8)
    if len(buf):
        out[:, :LENGTH] = np.where(on < end[:, None], buf[np.minimum(on, len(buf) - 1)], 0)
        out[:, LENGTH:] = np.where(back >= begin[:-1, None], buf[np.maximum(back, 0)], 0)
    return out


def symbols(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte symbols that sort alike."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def multikey(keys: np.ndarray) -> np.ndarray:
    """The order of rows of symbols by multikey quicksort.

    A part is split three ways by a pivot symbol: what is below and above it is split on by the same symbol, what is
    equal by the next one. Small parts are sorted by their remaining symbols at once.
    """
    out, todo, depth = [], [(np.arange(len(keys)), 0)], keys.shape[1]
    while todo:
        rows, k = todo.pop()
        if k == depth or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= SMALL:
            out.append(rows[np.lexsort(keys[rows, k:].T[::-1])])
        else:
            symbol = keys[rows, k]
            some = np.sort(symbol[:: len(symbol) // 101 + 1])
            pivot = some[len(some) // 2]
            todo += [(rows[symbol > pivot], k), (rows[symbol == pivot], k + 1), (rows[symbol < pivot], k)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows of bytes share."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of rows of bytes, and what each row in it shares with the one before (-1 for the first)."""
    order = multikey(symbols(rows))
    shared = np.full(len(rows), -1)
    shared[1:] = shared_prefix(rows[order[1:]], rows[order[:-1]])
    return order, shared


def repeated(rows: np.ndarray, ids: np.ndarray, off: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest number of bytes before the anchor with which a suffix has a window that stands under a smaller id; -1 for none.

    Two suffixes share the window that begins ``l`` bytes before the anchor if they share ``LENGTH - l`` bytes from it on
    and ``l`` before it: if, in the two sorted orders, no neighbours between them share less.
    """
    n = len(ids)
    most, least = np.full(n, -1), np.full(n, -1)
    order, on = neighbours(rows[:, :LENGTH])
    reverse, back = neighbours(rows[:, LENGTH:])
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(BEFORE + 1):  # noqa: E741
        some = np.flatnonzero((off >= l) & (off - windows < l))
        if len(some) < 2:
            continue
        ahead[order] = np.cumsum(on < LENGTH - l)
        behind[reverse] = np.cumsum(back < l)
        both = ahead[some] * (n + 1) + behind[some]
        sort = np.argsort(both)
        some = some[sort]
        hit = some[smallest(edges(both[sort]), ids[some]) < ids[some]]
        most[hit] = l
        least[hit] = np.where(least[hit] < 0, l, least[hit])
    return most, least


def splitters(found: DataFrame, n: int, buckets: int) -> np.ndarray:
    """The borders of buckets, as rows of bytes: quantiles of a sample of ``OVERSAMPLE`` suffixes for each bucket."""
    share = min(1.0, OVERSAMPLE * buckets / max(n, 1))
    chosen = F.xxhash64("doc_id", "key", "start", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))
    sample = found.filter(chosen).select("off", "c").toArrow()
    if not sample.num_rows:
        return np.zeros((0, LENGTH + BEFORE), np.uint8)
    rows = sides(*flat(sample.column("c").combine_chunks()), sample.column("off").to_numpy().astype(np.int64))
    rows = rows[multikey(symbols(rows))]
    return rows[np.arange(1, buckets) * len(rows) // buckets]


def text_key(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-width strings."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def placed(found: DataFrame, borders: np.ndarray) -> DataFrame:
    """The suffixes with their bucket, and (bucket -1) the windows that may have equals in other buckets, as ``c``."""
    shared = found.sparkSession.sparkContext.broadcast(borders)

    def make(batches):
        borders = shared.value
        keys = text_key(borders)
        for batch in batches:
            off = batch.column(3).to_numpy().astype(np.int64)
            buf, begin = flat(batch.column(4))
            rows = sides(buf, begin, off)
            bucket = np.searchsorted(keys, text_key(rows), "right")
            upto = np.full(len(rows), -1)
            for k in (bucket - 1, bucket):
                ok = np.flatnonzero((k >= 0) & (k < len(borders)))
                upto[ok] = np.maximum(upto[ok], shared_prefix(rows[ok, :LENGTH], borders[k[ok], :LENGTH]))
            windows = np.diff(begin) - LENGTH + 1
            low = np.maximum(off - windows + 1, LENGTH - upto)  # bytes before the anchor of the last window in question
            n = np.where(upto < 0, 0, np.maximum(0, off - low + 1))
            row = np.repeat(np.arange(len(rows)), n)
            before = off[row] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            moved = off[row] - before
            c = stretches(buf, begin[row] + moved, np.full(len(row), LENGTH))
            ids, key, start = (batch.column(k).to_numpy() for k in range(3))
            names = ["bucket", "doc_id", "key", "start", "off", "c"]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], names)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), -1, np.int32)), pa.array(ids[row]), pa.array(key[row]), pa.array(start[row] + moved), pa.array(np.zeros(len(row), np.int32)), c], names)

    return found.mapInArrow(make, "bucket int, doc_id long, key long, start long, off int, c binary")


def compared(inside: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, key, start, end): what suffixes have in common with others of their bucket."""

    def find(group: pa.Table) -> pa.Table:
        ids, key, start, off = (group.column(c).to_numpy() for c in ("doc_id", "key", "start", "off"))
        off = off.astype(np.int64)
        buf, begin = flat(group.column("c").combine_chunks())
        most, least = repeated(sides(buf, begin, off), ids, off, np.diff(begin) - LENGTH + 1)
        hit = np.flatnonzero(most >= 0)
        return pa.table({"doc_id": ids[hit], "key": key[hit], "start": (start + off - most)[hit], "end": (start + off - least)[hit] + LENGTH})

    return inside.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(find, "doc_id long, key long, start long, end long")


def across(windows: DataFrame) -> DataFrame:
    """(doc_id, key, start, end): windows at the borders of buckets that stand under a smaller id."""
    least = windows.groupBy("c").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return windows.join(least, "c").filter("doc_id > low").select("doc_id", "key", "start", (F.col("start") + LENGTH).alias("end"))


def removable(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, end): what is to be removed from the documents (doc_id, key, text); it may overlap."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    frequent = frequent_anchors(docs)
    state = materialize(decided(packed_runs(docs, buckets, frequent, random_keys()), buckets, frequent), "runs")
    release(spark)
    found = materialize(suffixes(docs, state.filter("off >= 0")), "suffixes")
    n = found.count()
    wide = max(BUCKETS, -(-n // SUFFIXES))  # no more than needed: every border costs windows that meet across it
    put = materialize(placed(found, splitters(found, n, wide)), "placed")
    release(spark, found)
    whole = state.filter("off < 0").select("doc_id", "key", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    partly = compared(put.filter("bucket >= 0"), wide).unionByName(across(put.filter("bucket < 0")))
    out = materialize(whole.unionByName(partly), "intervals")
    release(spark, state, put)
    return out


def spans(text_begin: np.ndarray, counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the merged intervals of each row, as places in the buffer of all rows' texts."""
    row = np.repeat(np.arange(len(counts)), counts)
    a, b = text_begin[row] + start, text_begin[row] + end
    order = np.argsort(a, kind="stable")
    a, b, row = a[order], np.maximum.accumulate(b[order]) if len(a) else b, row[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return row[first], a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document and the bytes left of it, as binary."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))  # the key parts rows of one id
    found = removable(plain.filter(F.col("doc_id").isNotNull()))
    cuts = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            buf, begin = flat(batch.column(1))
            lists = batch.column(2)
            counts = np.diff(np.asarray(lists.offsets))
            both = lists.flatten()
            row, a, b = spans(begin[:-1], counts, both.field(0).to_numpy(), both.field(1).to_numpy())
            n = len(counts)
            gone = np.bincount(row, b - a, n).astype(np.int64)
            # What is kept lies between the spans: from the begin of each text or the end of a span to the next span or the end of the text.
            cell = np.concatenate([np.arange(n), row])
            low = np.concatenate([begin[:-1], b])
            order = np.lexsort((low, cell))
            cell, low = cell[order], low[order]
            ends = np.concatenate([a, begin[1:]])[np.lexsort((np.concatenate([a, begin[1:]]), np.concatenate([row, np.arange(n)])))]
            size = ends - low
            kept = stretches(buf, low, size)
            upto = np.concatenate([[0], np.cumsum(np.bincount(cell, size, n).astype(np.int64))])
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(upto.astype(np.int32).tobytes()), kept.buffers()[2]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin)), pa.array(gone), pa.array(np.bincount(row, minlength=n).astype(np.int64)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    met = plain.join(cuts, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("cuts", none).alias("cuts"))
    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS MATERIALIZED (SELECT uid, doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM (SELECT uid, doc_id, x, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS p FROM docs WHERE doc_id IS NOT NULL)),
least_ AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT uid, p FROM windows JOIN least_ USING (w) WHERE doc_id > low),
marked AS (SELECT uid, p, CASE WHEN p - lag(p) OVER (PARTITION BY uid ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT uid, p, sum(fresh) OVER (PARTITION BY uid ORDER BY p) AS span FROM marked),
spans AS (SELECT uid, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY uid, span),
gaps AS (SELECT uid, a, b, coalesce(lag(b) OVER (PARTITION BY uid ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT uid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS upto, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM gaps JOIN docs USING (uid) GROUP BY uid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (uid)
"""
