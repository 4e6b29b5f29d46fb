"""Document fingerprints: Merkle trees over the paragraphs and sections of a text.

Leaves are phrases (pieces of 32 characters and what is left of the last word, with the marks that end them); a paragraph ends with a
line, a section with an empty line or after a paragraph whose last leaf's hash says so, so that an edit moves
borders near itself only. The root, a hash of hashes, tells whether texts are equal; where roots differ, equal
branches are matched from sections down to leaves, and what is left locates the edits.

A fingerprint is ``root|section/section...``; a section is ``paragraph;paragraph...``, a paragraph
``leaf,leaf...``, and a leaf 8 hex digits of its hash and its length in hex.

Defined results: a null text is empty; the empty text has a root and no sections; likeness of equal texts is 1,
of an empty and another text 0; repeated rows keep their rows, and rows of equal ids follow each other in the
order of their texts; null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = re.compile(r"[^\n.!?;|,]{1,32}[^\s.!?;|,]{0,32}[\n.!?;|,]*|[\n.!?;|,]+")
#: Bytes of text in a range of ids, sampled ids for each range, and ranges at most: beyond these, ranges hold more, through
#: which tasks stream, and neither the driver's lists nor the number of tasks grow.
RANGE_BYTES, SAMPLED, RANGES = 1 << 23, 32, 20_000


def fingerprint(text: str) -> str:
    """The serialised tree of a text."""
    sections, paragraphs, leaves = [], [], []
    root, branch, twig = hashlib.sha256(), hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16)
    for leaf in LEAF.findall(text):
        h = hashlib.blake2b(leaf.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        leaves.append(f"{h[:4].hex()}{len(leaf):x}")
        twig.update(h)
        if "\n" in leaf:
            paragraphs.append(",".join(leaves))
            branch.update(twig.digest())
            leaves, twig = [], hashlib.blake2b(digest_size=16)
            if h[6] % 8 == 0 or "\n\n" in leaf:
                sections.append(";".join(paragraphs))
                root.update(branch.digest())
                paragraphs, branch = [], hashlib.blake2b(digest_size=16)
    if leaves:
        paragraphs.append(",".join(leaves))
        branch.update(twig.digest())
    if paragraphs:
        sections.append(";".join(paragraphs))
        root.update(branch.digest())
    return f"{root.hexdigest()}|{'/'.join(sections)}"


def _left(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Two lists without what they share."""
    shared = Counter(a) & Counter(b)

    def rest(x: list[str]) -> list[str]:
        taken, out = Counter(shared), []
        for v in x:
            if taken[v]:
                taken[v] -= 1
            else:
                out.append(v)
        return out

    return rest(a), rest(b)


def _size(leaves: list[str]) -> int:
    return sum(int(x[8:], 16) for x in leaves)


def likeness(a: str, b: str) -> float:
    """The share of two texts, by their fingerprints, that lies in equal leaves (0 to 1)."""
    if a[:64] == b[:64]:
        return 1.0
    parts = [[f[65:]] if f[65:] else [] for f in (a, b)]
    whole = sum(_size([x for x in re.split("[/;,]", f[65:]) if x]) for f in (a, b))
    for mark in "/;,":
        parts = list(_left(*[[x for p in side for x in p.split(mark)] for side in parts]))
    return 1 - (_size(parts[0]) + _size(parts[1])) / whole


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of the first text (code points, end exclusive) whose leaves the second one lacks."""
    if a[:64] == b[:64]:
        return []
    have, out, at = Counter(x for x in re.split("[/;,]", b[65:]) if x), [], 0
    for leaf in (x for x in re.split("[/;,]", a[65:]) if x):
        end = at + int(leaf[8:], 16)
        if have[leaf]:
            have[leaf] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
        at = end
    return out


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by the beginning of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def borders_of(docs: DataFrame) -> list[int]:
    """The first ids of ranges of about ``RANGE_BYTES`` of text, ``RANGES`` at most, largest first; from a sample of ids and sizes."""
    size = F.octet_length("text").cast("long")
    n, total = docs.filter(F.col("doc_id").isNotNull()).agg(F.count("*"), F.sum(size)).first()
    ranges = min((total or 0) // RANGE_BYTES + 1, RANGES)
    if ranges < 2:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    chosen = F.xxhash64("doc_id", F.lit(17)).bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))
    sample = docs.filter(F.col("doc_id").isNotNull() & chosen).select("doc_id", size.alias("size")).toPandas().sort_values("doc_id", ascending=False)
    upto = sample["size"].cumsum().to_numpy()
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges)) if len(upto) else []
    return sorted({int(x) for x in sample["doc_id"].to_numpy()[at]}, reverse=True)


def in_ranges(docs: DataFrame) -> DataFrame:
    """(part, last, doc_id, text): ranges of descending ids, sorted, and after each range the first row of the next.

    The row after the last range is the very first. Only sampled ids and the largest id of each range pass through the
    driver, at most ``RANGES`` times what there is of each; texts are shuffled once, each range to a partition of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A border is the smallest id of its range; ids below the last one, and nulls, are in the last range.
    rising = np.array(borders_of(docs)[::-1], np.int64)
    places = len(rising) + 1

    def place(ids: np.ndarray) -> np.ndarray:
        return len(rising) - np.searchsorted(rising, ids, "right")

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(np.where(there, place(ids.fill_null(0).to_numpy()), places - 1).astype(np.int32))

    found = docs.select("doc_id", part_of("doc_id").alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    heads = [r["head"] for r in found]
    parts = np.array([r["part"] for r in found], np.int64)
    # The head of each range that has rows goes to the range before it, too; that of the first to the last.
    known = np.array(sorted(h for h in heads if h is not None), np.int64)
    before = {h: int(parts[k - 1]) for k, h in enumerate(heads)}
    goes = np.array([before[h] for h in known.tolist()], np.int64)

    @F.arrow_udf("array<struct<part:int,last:int>>")
    def places_of(ids: pa.Array) -> pa.Array:
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy()
        own = np.where(there, place(x), places - 1)
        k = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
        head = there & (known[k] == x) if len(known) else np.zeros(len(x), bool)
        to = goes[k] if len(known) else own
        if None in before:
            head, to = head | ~there, np.where(there, to, before[None])
        each = 1 + head.astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        part, last = np.empty(ends[-1], np.int32), np.zeros(ends[-1], np.int32)
        part[ends[:-1]] = own
        part[ends[1:][head] - 1], last[ends[1:][head] - 1] = to[head], 1
        rows = pa.StructArray.from_arrays([pa.array(part), pa.array(last)], ["part", "last"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)

    every = docs.select(F.explode(places_of("doc_id")).alias("p"), "doc_id", "text").select("p.part", "p.last", "doc_id", "text")
    return every.repartitionById(places, "part").sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and its likeness to that and to the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches):
        held = None  # the row before, with its fingerprint
        out: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for part, last, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    print_ = fingerprint(text)
                    if held and held[0] == part:
                        _, old_id, old, old_print = held
                        new = edited(old, text)
                        new_print = fingerprint(new)
                        sha = hashlib.sha256(new.encode()).hexdigest()
                        out.append((old_id, len(old), sha, old_print, new_print, likeness(old_print, new_print), likeness(old_print, print_)))
                    held = None if last else (part, doc_id, text, print_)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []

    return in_ranges(docs).mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and edited_sha256 of every document."""
    return compare_with_next(docs).select("doc_id", "n_chars", "edited_sha256")


ORACLE_EDITED = """
WITH ordered AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS after
  FROM documents WINDOW w AS (ORDER BY doc_id DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars,
  sha256(substr(t, 1, length(t) - length(t) // 3) || substr(after, 1, length(t) // 3)) AS edited_sha256
FROM ordered
"""
