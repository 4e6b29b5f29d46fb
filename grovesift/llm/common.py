"""Shared pieces of the corpus operators: scratch tables, bounded samples and vectorised word hashing.

Word hashing works on UTF-8 bytes with numpy: one prefix sum of ``byte * BASE**i`` gives the polynomial
hash of every word in a buffer at once. All arithmetic is modulo 2**64; words hash equal when their
(A-Z lower-cased) bytes are equal, and unequal words collide with a probability near 2**-64.
"""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, written

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
#: Longest buffer that is hashed at once; longer ones are cut at white space.
PIECE = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches to 1,000 rows: texts are long, and a batch exists several times over in the JVM and in Python.

    Plans read the setting when they run, so it stays: it is one of the session that runs them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def bytes_per_batch(spark: SparkSession) -> None:
    """Ends Arrow batches at 32 MB too, for tables whose rows are packed blocks."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage at a copy that outlives executors."""
    return written(df, tag, "zstd")


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark delete the shuffle files of finished plans.

    Spark drops a shuffle's files once the driver's garbage collector has found that no plan refers to it; on a
    driver with little to do that may be long after the job.
    """
    drop(*tables)
    for _ in range(2):  # Python's handles go first, then what they held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows at most, those with the smallest hash of ``key`` (ties: of the text); the same rows on every run.

    A first pass over ``key`` alone finds the hash below which about ``n`` rows lie, so that the second pass
    moves the texts of those rows only.
    """
    h = F.xxhash64(F.col(key), F.lit(11))
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if cut is None:
        return df.limit(0)
    return df.filter(h <= cut).orderBy(h, F.xxhash64("text")).limit(n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_words(buf: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in a buffer of bytes; ``space`` tells which bytes part words."""
    n = len(buf)
    if n > 2 * PIECE:  # cut behind a white space, or leave a word that has none whole
        cuts, at = [], 0
        spaces = np.flatnonzero(space[buf])
        while n - at > 2 * PIECE:
            k = np.searchsorted(spaces, at + PIECE)
            if k == len(spaces) or spaces[k] + 1 >= n:
                break
            cuts.append(at := int(spaces[k]) + 1)
        if cuts:
            parts = [(*hash_words(p, space), s) for s, p in zip([0, *cuts], np.split(buf, cuts), strict=True)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + p[2] for p in parts])
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~space[buf]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(max(n, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, np.uint64), starts


def blocks(texts: list[bytes | None], size: int = PIECE):
    """(first document, end document) ranges of about ``size`` bytes each; a longer document stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if held and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes | None], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several documents, in order, and for each document where its words begin and end."""
    buf = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    hashes, starts = hash_words(buf, space)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    at = np.searchsorted(starts, np.concatenate([[0], ends]))
    return hashes, at[:-1], at[1:]


def binary(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    kind = column.type
    return column.cast(pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).to_pylist()


#: Odd multipliers, one for each place in a shingle.
PLACES = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(1, 65)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words, one of the whole sequence; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, k)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * PLACES[j]
    return mix(out + np.uint64(k))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)
