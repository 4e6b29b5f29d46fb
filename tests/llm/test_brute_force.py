"""Operators that SQL can't express, against plain loops; measured recall; odd tables in the pipeline."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovesift.llm import bpe, decontam, hmm, langid, merkle, neardup, secrets
from grovesift.llm.common import tokenizer_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"


def test_language_predictions_are_those_of_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(9001, None), (9002, ""), (9003, "12 34"), (9004, "Ünï"), (9005, "x" * 80_000), (None, "the and of"), (9004, "Ünï")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("clash"))
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))

    def plain(text):
        padded = "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} ")
        total, n = model.bias * 0, 0
        for size in langid.SIZES:
            for i in range(len(padded) - size + 1):
                s = padded[i : i + size]
                if not any(c != "\0" for c in s) or any(c == "\0" for c in s[1:-1]):
                    continue
                h = (ord(s[0]) + size) & 0xFFFFFFFF
                for c in s[1:]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                h ^= h >> 15
                total = total + model.table[(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS)]
                n += 1
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0
        z = (total / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return model.langs[int(p.argmax())], float(p.max())

    rows = langid.identify(docs, model).collect()
    for r in rows:
        lang, score = plain(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6 and r.rejected == (lang == "und" or r.score < model.reject), r.doc_id
    assert len(rows) == 67


def best_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_contaminated_pairs_are_those_of_full_alignment(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    items = [(k, [rng.choice(common) if rng.random() < 0.4 else f"i{k % 7}w{rng.randrange(25)}" for _ in range(rng.randint(8, 30))]) for k in range(14)] + [(50, ["yes", "no", "yes"]), (51, []), (52, ["c1"] * 9)]
    docs = []
    for d in range(90):
        text = rng.choices(common, k=rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            copy = [w for w in rng.choice(items)[1] for w in ([w] if rng.random() > 0.12 else rng.choice([[], ["so"], [w, "so"]]))]
            at = rng.randint(0, len(text))
            text[at:at] = copy
        docs.append((d, text))
    docs += [(500, list(items[3][1]) * 3), (501, ["c1"] * 400), (502, [])]
    want = {}
    for d, text in docs:
        for i, item in items:
            n, score = len(item), best_alignment(item, text) if len(item) >= decontam.SHORT else 0
            if n >= decontam.SHORT and score >= decontam.LEAST * 2 * n:
                want[d, i] = score / (2 * n)
            elif 0 < n < decontam.SHORT and any(text[k : k + n] == item for k in range(len(text) - n + 1)):
                want[d, i] = 1.0
    rows = spark.createDataFrame([(d, " ".join(t), "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    found = decontam.contaminated(rows, spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == pytest.approx(want) and len(want) > 60


@pytest.mark.parametrize(("edits", "least"), [(0.1, 1.0), (0.2, 0.97), (0.25, 0.9)])
def test_recall_of_paraphrased_items(edits, least):
    """Words replaced, added or lost at random, in items of 20 to 60 words."""
    rng = random.Random(8)
    items = [[f"i{k}w{j}" for j in range(rng.randint(20, 60))] for k in range(300)]
    docs = [" ".join(x for w in item for x in ([w] if rng.random() > edits else rng.choice([[f"n{rng.random()}"], [], [w, "more"]]))) for item in items]
    index = decontam.Index.of(list(range(300)), [" ".join(i).encode() for i in items])
    h, a, b = decontam.words_in([d.encode() for d in docs])
    found = index.seeds(np.ones(len(index.keys), np.int64)).matches(h, a, b)
    assert sum(any(i == k for i, *_ in f) for k, f in enumerate(found)) / 300 >= least


def test_merkle_trees_and_likeness_are_those_of_plain_lists(spark):
    def tree(text):
        """Sections of paragraphs of leaves (hash, text)."""
        sections, paragraphs, leaves = [], [], []
        for leaf in merkle.LEAF.findall(text):
            leaves.append((hashlib.blake2b(leaf.encode(), digest_size=16).digest(), leaf))
            if "\n" in leaf:
                paragraphs.append(leaves)
                if leaves[-1][0][6] % 8 == 0 or "\n\n" in leaf:
                    sections.append(paragraphs)
                    paragraphs = []
                leaves = []
        paragraphs += [leaves] * bool(leaves)
        return sections + [paragraphs] * bool(paragraphs)

    def root(t):
        hashed = lambda parts, f=lambda x: hashlib.blake2b(x, digest_size=16): f(b"".join(parts)).digest()
        return hashlib.sha256(b"".join(hashed([hashed([h for h, _ in p]) for p in s]) for s in t)).hexdigest()

    name = lambda leaf: (leaf[0][:4], len(leaf[1]))

    def alike(a, b):
        if root(a) == root(b):
            return 1.0
        whole = sum(len(x) for t in (a, b) for s in t for p in s for _, x in p)
        sides = [[tuple(tuple(name(x) for x in p) for p in s) for s in t] for t in (a, b)]
        for level in range(3):
            both = Counter(sides[0]) & Counter(sides[1])
            sides = [list((Counter(x) - both).elements()) for x in sides]
            sides = [[y for x in side for y in x] for side in sides] if level < 2 else sides
        left = sum(n for side in sides for _, n in side)
        return 1 - left / whole

    rng = random.Random(13)
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() if r.text]
    texts = ["", "a", "\n", "\n\n", "x" * 70_001, *real, *(t.replace(rng.choice(t.split() or ["a"]), "edited", 1) for t in real), *(rng.choice(real) + "\n\n" + rng.choice(real) for _ in range(30))]
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        assert merkle.fingerprint(a).startswith(root(tree(a)) + "|")
        assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == pytest.approx(alike(tree(a), tree(b)))
        assert "".join(x for s in tree(a) for p in s for _, x in p) == a


def test_hidden_markov_scores_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 60)
    monkeypatch.setattr(hmm, "OWN", 20)
    rng = random.Random(17)
    words = [f"{p}{i}" for p in "abc" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words[60 * (i % 3) :][:60], k=rng.randint(0, 70)))) for i in range(160)] + [(900, None), (901, "unseen words a1"), (902, "a1 " * 3000), (None, "A1 b1"), (5, "c1 c2")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    training = docs.filter(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))
    counts = hmm.count_tokens(training)
    gains = []
    lex, model = hmm.fit(training, counts, gains)
    assert 2 <= len(gains) <= hmm.ROUNDS and all(b >= a - 1e-6 for a, b in zip(gains, gains[1:], strict=False))
    known = {int(np.uint64(r.h & (1 << 64) - 1)): r.c for r in counts.collect()}
    own = sorted(known, key=lambda h: (-known[h], h - (1 << 64) * (h >> 63)))[:20]
    n, v = Counter(), Counter()
    for h, c in known.items():
        if h not in own:
            n[(h >> 40) % hmm.SHARED] += c
            v[(h >> 40) % hmm.SHARED] += 1

    def plain(text):
        p, total = model.start, 0.0
        for h in hmm.tokens([(text or "").encode()])[0].tolist():
            if h in own:
                kind, within = own.index(h), 1.0
            else:
                k = (h >> 40) % hmm.SHARED
                kind, within = 20 + k, (known.get(h, 0) + hmm.ADD) / (n[k] + hmm.ADD * (v[k] + 1))
            p = p * model.emit[kind] * within
            total += math.log10(p.sum())
            p = (p / p.sum()) @ model.move
        return total

    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in hmm.score(docs).collect())
    want = sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1, plain(t)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)


def test_recall_of_random_strings_by_alphabet_and_length(spark):
    model = secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(9)
    for letters in (string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"):
        for size in (16, 20, 32):
            caught = sum(model.score("".join(rng.choices(letters, k=size))) > model.threshold for _ in range(500)) / 500
            assert caught >= 0.9, (letters, size, caught)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    assert model.spans(f"some words {key} and the ordinary_names_of_things") == [("random", 11, 51)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = secrets.digests(docs, model).agg(F.sum("n_random")).first()[0]
    assert found <= 2 and secrets.digests(docs.limit(0), model).count() == 0


def test_base_spans_are_those_of_a_plain_scan():
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "a1", "AKIA", "AKIA" + "Z" * 12, "0f" * 16, "0f" * 15, "é", "\n", "-", "x" * 90]

    def plain(text):
        out, at = [], 0
        while at < len(text):  # assignments, leftmost and not overlapping
            for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if text[at : at + len(word)].translate(LOWER) == word:
                    k = at + len(word)
                    k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                    while text[k : k + 1] == " ":
                        k += 1
                    if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                        continue
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                    end = k
                    while end < len(text) and text[end] in string.ascii_letters + string.digits + "+/_.=-":
                        end += 1
                    if end > k:
                        out += [("assign", at, end)] * (end - k >= 8)
                        at = end - 1
                        break
            at += 1
        for kind, first, letters, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 16), ("hex", "", "0123456789abcdef", 32)):
            at = 0
            while at < len(text):
                end = at + len(first)
                while text.startswith(first, at) and end < len(text) and text[end] in letters:
                    end += 1
                if text.startswith(first, at) and end > at + len(first):
                    out += [(kind, at, end)] * (end - at >= least)
                    at = end - 1
                at += 1
        return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))

    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == plain(text), text


@pytest.mark.parametrize("size", [10, 60, 400])
def test_pairs_at_the_threshold_share_a_band(size):
    """20,000 documents in pairs at similarities from 0.75 to 0.8 (fewer of the large ones)."""
    rng = np.random.default_rng(size)
    pairs, missed = {10: 5000, 60: 4000, 400: 1000}[size], 0
    for k in range(pairs):
        j = 0.75 + 0.05 * (k % 2)
        same = math.ceil(2 * size * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        r = np.stack([neardup.registers(x[:size]), neardup.registers(np.concatenate([x[:same], x[size : 2 * size - same]]))])
        a, b = neardup.band_keys(r)
        missed += not len(np.intersect1d(a, b))
    assert missed == 0


def test_long_pretokens_are_guessed_and_verified(monkeypatch):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer(tokenizer_path())
    rng, exact = random.Random(3), []
    monkeypatch.setattr(mine, "exact", lambda w, f=mine.exact: (exact.append(w), f(w))[1])
    words = ["".join(rng.choice(["tion", "the", "ing", "x", "q", "ß", "漢"]) for _ in range(rng.randint(12, 60))) for _ in range(400)] + ["a" * 70_000, "=" * 5000, "ab" * 300]
    assert [x.tolist() for x in mine.encode_batch(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert len(exact) < len(words)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, ids string, component_id long, label string, item_id long, key string"
    texts = [f"some words of document number {k} that nobody else has, {k * k} and {k**3} at that" for k in range(20)] + [None, "", "some words " + passage]
    rows = [(k, t, None, None, None, "k", 0.5, "x", 1, "l", 2, "c") for k, t in enumerate(texts)] + [(None, "no id at all here", None, None, None, "k", 0.5, "x", 1, "l", 2, "c")]
    unlabelled = spark.createDataFrame(rows, clash)
    assert corpus_pipeline.language_id(spark, unlabelled, str(tmp_path)).count() == len(rows)  # nothing learned, nothing rejected
    for name, docs in (("clash", unlabelled), ("empty", unlabelled.limit(0)), ("bare", unlabelled.select("doc_id", "text"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        got = out.collect()
        assert {r.doc_id for r in got} == (set() if name == "empty" else {*range(22), None}) and all(r.round_trip for r in got)
        now = docs
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, f"{tmp_path}/{name}")
            assert now.columns == [*docs.columns, *(["lang"] if name == "bare" else [])], stage


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    from grovesift import scratch

    assert scratch.folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

    with pytest.raises(RuntimeError):
        scratch.folder(Far)
    Far.sparkContext.master = "local[4]"
    assert scratch.folder(Far).startswith("file://")
    table = scratch.written(spark.range(3), "test")
    (path,) = {f.rpartition("/")[0].removeprefix("file://") for f in table.inputFiles()}
    scratch.drop(table)
    import os

    assert not os.path.exists(path)

