"""Rows that repeat many times cost their number, not its square."""

import random

import pytest
from pyspark.sql import functions as F

from grovesift.llm import neardup, substrings


def text(rng, n=400):
    return " ".join(rng.choice("river stone cloud ember maple quartz fern".split()) + str(rng.randrange(300)) for _ in range(n))


@pytest.mark.parametrize("copies", [50, 500])
def test_repeated_rows_in_substrings(spark, copies):
    rng = random.Random(1)
    shared, other = text(rng), text(rng)
    rows = [(0, shared + " tail"), *((1, "head " + shared + " between " + other),) * copies, (2, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    wanted = plain.filter("doc_id = 1").select("doc_id", "key", F.explode(F.expr("array(named_struct('start', 5L, 'windows', 20, 'off', 3), named_struct('start', 90L, 'windows', 9, 'off', 2))")).alias("r")).select("doc_id", "key", "r.*")
    assert substrings.suffixes(plain, wanted).count() == 2 * copies
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in substrings.deduplicate(docs).collect()}
    assert substrings.deduplicate(docs).count() == copies + 2 and {d for d, n, _ in got if n == 0} == {0}
    assert {(d, s) for d, _, s in got} == {(0, 0), (1, 1), (2, 1)} and {n >= len(shared) - 1 for d, n, _ in got if d == 1} == {True}


@pytest.mark.parametrize("copies", [40, 160])
def test_repeated_rows_in_near_duplicates(spark, copies, monkeypatch):
    rng = random.Random(2)
    base = text(rng, 300).split()
    near = base[:280] + ["x"] * 3 + base[283:]
    rows = [(1, " ".join(base))] * copies + [(2, " ".join(near))] * copies + [(1, "an other text of the same id " * 3)] * copies + [(3, text(rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compared, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda c, sets: compared.append(neardup.both_ends(c, sets, "s").count()) or verified(c, sets))
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)} and compared == [2]  # two sets of document 1, whatever the number of rows


def test_blocks_are_cut_by_bytes_too(spark, monkeypatch):
    """Long sets make small blocks; the links are the same."""
    rng = random.Random(3)
    base = text(rng, 120).split()
    rows = []
    for i in range(40):  # a chain of documents, each close to the next ones
        words = list(base)
        words[3 * i : 3 * i + 3] = [f"n{i}", f"m{i}", f"k{i}"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.component_id) for r in neardup.groups(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4096)
    assert {(r.doc_id, r.component_id) for r in neardup.groups(docs).collect()} == whole
