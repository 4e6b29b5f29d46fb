"""Benchmark decontamination: rare pairs of words as seeds, and Smith-Waterman alignment.

Words are runs of ASCII letters and digits (A-Z lower-cased) and bytes beyond ASCII; each character of a script
without spaces (``UNSPACED``) is a word. An item is aligned with the
words around its seeds in a document: a match scores 2, a replaced, added or lost word -1. The score of a pair is
that of its best alignment divided by that of an exact copy; from ``LEAST`` on the pair is reported. Edited and
paraphrased copies score in between.

Seeds lose no such alignment. One of m matches and e edits has 2 m - e >= 2 LEAST n for an item of n words, so that
at most m - LEAST n of the m - 1 steps from a match to the next cost two edits or more. The others, ``steps(n)`` =
LEAST n - 1 at least, go on by one or two words on either side. So a place's keys are the pairs of its word with the
first and the second word behind it, in items as in documents, and an aligned document has keys of ``steps(n)``
different places of the item. Keys are counted over the whole training corpus; an item's seeds are those of its
rarest n - 1 - ``steps(n)`` + ``HITS`` places, of which any aligned document has ``HITS``. This holds whatever the
counts are. Where a document holds so many near each other, all keys are counted, and with ``steps(n)`` of them the
item is aligned.

Items go to the workers in blocks of ``ITEM_BYTES`` text each, a stated bound; the corpus is read twice for each
block, and nothing of it is shuffled but the counts of the block's keys.

Items of fewer than ``SHORT`` words are reported, with a score of 1, where all of their words stand in a row, even if
it is one word.

Defined results: null and empty texts, and items without words, match nothing; repeated rows, and items that are copies of each other, give a pair each; null ids are kept; an empty table on
either side gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACES, binary, blocks, mix, words_of

HITS, LEAST, SHORT = 2, 0.5, 8
ITEM_BYTES = 1 << 24
MATCH = "array<struct<item_id:bigint,score:double,start:int,end:int>>"
#: Bytes that part words here: all of ASCII but letters and digits.
PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Characters of scripts without spaces, in UTF-8: Thai and Lao; Burmese; Khmer; Japanese and Chinese.
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb].|\xe1[\x80-\x82\x9e\x9f].|[\xe3-\xe9]..|\xef[\xa4-\xab].|\xef\xbd[\xa6-\xbf]|\xef\xbe[\x80-\x9f]|\xf0[\xa0-\xb3]..", re.DOTALL)
#: Their punctuation, which parts words as that of ASCII does.
MARKS = re.compile(rb"\xe3\x80[\x80-\x84\x88-\xa0\xb0]|\xe3\x83\xbb|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
_LOW = bytes(range(0xE0))
_FILTER = 20


def words_in(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several documents, in order, and for each document where its words begin and end."""
    return words_of([UNSPACED.sub(rb" \g<0> ", MARKS.sub(b" ", t)) if t and t.translate(None, _LOW) else t for t in texts], PARTS)


def rows_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * PLACES[j]
    return mix(out)


def pairs(h: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of each word with the one ``gap`` words behind it."""
    return mix(h[:-gap] * PLACES[0] + h[gap:] * PLACES[1])


def steps(n):
    """Of how many places of an item of n words any alignment from ``LEAST`` on has keys."""
    return np.ceil(LEAST * n).astype(np.int64) - 1


@dataclass
class Index:
    """The items of a block and where their keys stand."""

    ids: list[int | None]
    words: list[np.ndarray]
    keys: np.ndarray  # sorted distinct keys
    first: np.ndarray  # for each key, where its places begin; one more than keys
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # whether any key has these leading bits
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: sorted hashes of short items, items

    @staticmethod
    def of(ids: list[int | None], texts: list[bytes | None]) -> Index:
        """An index of all places."""
        h, a, b = words_in(texts)
        words = [h[i:j] if j - i >= SHORT else h[:0] for i, j in zip(a, b, strict=True)]
        each = [pairs(w, gap) for w in words for gap in (1, 2)]
        size = [len(r) for r in each]
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in size)])
        short = {}
        for n in sorted({int(j - i) for i, j in zip(a, b, strict=True)} & set(range(1, SHORT))):
            item = np.flatnonzero(b - a == n)
            key = np.concatenate([rows_of(h[a[i] : b[i]], n) for i in item])
            order = np.argsort(key, kind="stable")
            short[n] = key[order], item[order]
        return Index._sorted(ids, words, np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(2 * len(words)) // 2, size), place, short)

    @staticmethod
    def _sorted(ids, words, key: np.ndarray, item: np.ndarray, place: np.ndarray, short: dict) -> Index:
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        maybe = np.zeros(1 << _FILTER, bool)
        maybe[keys >> np.uint64(64 - _FILTER)] = True
        return Index(ids, words, keys, np.append(first, len(key)), item[order], place[order], maybe, short)

    def seeds(self, counts: np.ndarray) -> Index:
        """An index of each item's rarest places, given how often each key stands in the corpus."""
        count = np.diff(self.first)
        n = np.array([len(w) for w in self.words], np.int64)
        begin = np.cumsum(n) - n
        at = begin[self.item] + self.place
        rarity = np.zeros(n.sum(), np.int64)
        np.add.at(rarity, at, np.repeat(counts, count))
        owner = np.repeat(np.arange(len(n)), n)
        last = np.zeros(len(rarity), bool)
        last[(begin + n)[n > 0] - 1] = True  # no word behind it
        order = np.lexsort((rarity, last, owner))
        rank = np.empty(len(rarity), np.int64)
        rank[order] = np.arange(len(rarity)) - begin[owner[order]]
        kept = (rank < (n - 1 - steps(n) + HITS)[owner])[at]
        return Index._sorted(self.ids, self.words, np.repeat(self.keys, count)[kept], self.item[kept], self.place[kept], self.short)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, numbers of keys) of the members of h that are keys."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]

    def hits(self, h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, places in h, numbers of keys) of the keys within documents whose words end before b in h."""
        found = []
        for gap in (1, 2):
            at, k = self.find(pairs(h, gap))
            doc = np.searchsorted(b, at, "right")
            inside = at + gap < b[doc]
            found.append((doc[inside], at[inside], k[inside]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, float, int, int]]]:
        """(item, score, first word, end) of the items that each document holds; its words are h[a:b]."""
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in a]
        for doc, i, low, high in self.candidates(h, b):
            item = self.words[i]
            n, low, high = len(item), max(int(a[doc]), low), min(int(b[doc]), high)
            near = h[low:high]
            own = np.unique(np.concatenate([pairs(item, 1), pairs(item, 2)]))
            total = np.zeros(len(near) + 1, np.int64)
            for gap in (1, 2):
                total[1 : len(near) - gap + 1] |= np.isin(pairs(near, gap), own)
            total = np.cumsum(total)
            if (total[2 * n :] - total[: -2 * n] if len(near) > 2 * n else total[-1:]).max() < steps(n):
                continue
            got, x, y = align(item, near)
            if got >= LEAST * 2 * n:
                at = low - int(a[doc])
                best[doc][i] = max(best[doc].get(i, (0.0, 0, 0)), (got / (2 * n), at + x, at + y))
        for n, (key, item) in self.short.items():
            at = np.arange(max(0, len(h) - n + 1))
            run = rows_of(h, n)
            low, high = np.searchsorted(key, run), np.searchsorted(key, run, "right")
            doc = np.searchsorted(b, at, "right")
            hit = np.flatnonzero((low < high) & (at + n <= b[doc]))
            for p in hit[np.unique(np.stack([doc[hit], low[hit]]), axis=1, return_index=True)[1]]:
                d, x = int(doc[p]), int(p - a[doc[p]])
                for i in item[low[p] : high[p]].tolist():
                    best[d][i] = (1.0, x, x + n)
        return [sorted((i, *m) for i, m in d.items()) for d in best]

    def candidates(self, h: np.ndarray, b: np.ndarray):
        """(document, item, first, end): where in h the seeds of ``HITS`` places of an item stand near each other.

        An alignment of an item of n words adds n words at most and so spans 2 n, which is how near hits must be and how
        far around them it may go.
        """
        doc, at, k = self.hits(h, b)
        if not len(at):
            return
        count = self.first[k + 1] - self.first[k]
        where = np.repeat(self.first[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc, p, i, q = np.repeat(doc, count), np.repeat(at, count), self.item[where], self.place[where]
        order = np.lexsort((p, i, doc))
        doc, p, i, q = doc[order], p[order], i[order], q[order]
        n = np.array([len(w) for w in self.words], np.int64)[i]
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(i) != 0) | (np.diff(p) > 2 * n[1:])])
        start, cluster = np.flatnonzero(new), np.cumsum(new) - 1
        places = np.bincount(np.unique(np.stack([cluster, q]), axis=1)[0])
        low, high = np.minimum.reduceat(p - q - n, start), np.maximum.reduceat(p - q + 2 * n, start)
        for c in np.flatnonzero(places >= HITS):
            yield int(doc[start[c]]), int(i[start[c]]), int(low[c]), int(high[c])


def ends_best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of words a and b, and where it ends in either."""
    row, steps = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    best = (0, 0, 0)
    for i, w in enumerate(a):
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == w, 2, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps  # added words cost 1 each
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i + 1, j)
        row = new
    return best


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The best score, and the span of ``words`` that it aligns."""
    score, i, j = ends_best(item, words)
    _, _, back = ends_best(item[:i][::-1], words[:j][::-1])
    return score, j - back, j


def count_keys(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each key of the index stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        index = shared.value
        total = np.zeros(len(index.keys), np.int64)
        for batch in batches:
            texts = binary(batch.column(0))
            for first, end in blocks(texts):
                h, _, b = words_in(texts[first:end])
                total += np.bincount(index.hits(h, b)[2], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["k", "c"])

    out = np.zeros(len(index.keys), np.int64)
    found = docs.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out[found["k"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return out


def rare(docs: DataFrame, ids: list[int | None], texts: list[bytes | None]) -> Index:
    """An index of the items' seeds."""
    index = Index.of(ids, texts)
    return index.seeds(count_keys(docs, index))


def indexes(docs: DataFrame, items: DataFrame):
    """Indexes over all items, a block of bounded size at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield rare(docs, [r[0] for r in rows], [r[1].encode() for r in rows])


def matches(text: Column, index, sc) -> Column:
    """The items that each text holds, as ``MATCH``; spans are in words."""
    shared = sc.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(MATCH)
    def find(column: pa.Array) -> pa.Array:
        texts, out, index = binary(column), [], shared.value
        for first, end in blocks(texts):
            h, a, b = words_in(texts[first:end])
            for found in index.matches(h, a, b):
                out.append([{"item_id": index.ids[m], "score": s, "start": x, "end": y} for m, s, x, y in found])
        return pa.array(out, kind)

    return find(text)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start, end): the pairs of documents and items that they hold."""
    spark = docs.sparkSession
    out = None
    for index in indexes(docs, items):
        one = docs.select("doc_id", F.explode(matches(F.col("text"), index, spark.sparkContext)).alias("m")).select("doc_id", "m.*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "cast(null as double) score", "cast(null as int) start", "cast(null as int) end")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    columns = docs.columns
    for index in indexes(docs, items):
        docs = docs.withColumn("_grovesift_items", matches(F.col("text"), index, docs.sparkSession.sparkContext)).filter(F.size("_grovesift_items") == 0).select(*columns)
    return docs
