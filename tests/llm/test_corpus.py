"""Operators over the whole corpus, against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from grovesift.llm import decontam, hmm, neardup, substrings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "src", None, "l", "c") for i, t in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of all degrees, shared passages, and odd rows."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows, base, passage = [], [say(60) for _ in range(6)], say(55)
    for i in range(150):
        kind, text = i % 5, base[i % 6].split()
        if kind < 3:
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
        elif kind == 3:
            rows.append(say(rng.randint(1, 40)) + " " + passage + " " + say(rng.randint(1, 40)))
        else:
            rows.append(say(rng.randint(1, 80)))
    rows += [None, "", " \n", "one", "One", "a b c d", "a b c d", "=" * 500, "x" + "=" * 300, rows[0], rows[0].upper(), say(3000), "é" * 90, "z" + "é" * 60]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3, t) for i, t in zip(order, rows, strict=True)]


def groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(table(spark, corpus)).collect()}
    want = groups(corpus)
    assert len({c for _, c, _ in want.values()}) < len(want) - 20
    assert got == want


def test_blocks_alone_find_all_links(spark, corpus, monkeypatch):
    """Without any star link the block comparison has to find everything."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "verified", lambda c, s: c.limit(0))
    got = {r.doc_id: r.component_id for r in neardup.groups(table(spark, corpus)).collect()}
    assert got == {i: c for i, (_, c, _) in groups(corpus).items()}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (1, None), (2, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.groups(table(spark, rows)).collect())
    assert got == [("1", 0, "1", True), ("2", 0, "2", True), ("5", 2, "5", True), ("5", 2, "5", True), ("9", 2, "5", False), ("None", 2, "None", True)]
    assert neardup.groups(table(spark, rows).limit(0)).collect() == []


def test_registers_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, j in ((10, 0.8), (300, 0.5), (4000, 0.75), (200, 0.0)):
        same = int(round(2 * n * j / (1 + j)))
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = x[:n], np.concatenate([x[:same], x[n : 2 * n - same]])
        got = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([n]), np.array([n]))[0]
        true = same / (2 * n - same)
        assert abs(got - true) < 0.13


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 205), (150, 205)]
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 101, 150, 205))
    assert neardup.components(spark.createDataFrame([], "a long, b long")) is None


def removed(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_substrings(spark, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(table(spark, corpus)).collect()}
    want = removed(corpus)
    assert sum(w[1] > 0 for w in want.values()) > 40 and got == want


@pytest.mark.parametrize("part", [50, 64, 130, 1 << 18])
def test_runs_hold_every_window_once_and_name_its_anchor_by_content(corpus, part):
    texts = [(t or "").encode() for _, t in corpus[:60]]
    seen, anchor_of = Counter(), {}
    for number, offset, buf, start in substrings.parts(texts, part):
        for p, first, last, anchor, h in zip(*substrings.runs(buf, start), strict=True):
            for q in range(first, last + 1):
                window = buf[q : q + 50].tobytes()
                seen[int(number[p]), int(offset[p] + q - start[p])] += 1
                assert window == texts[number[p]][offset[p] + q - start[p] :][:50] and 0 <= anchor - q <= 30
                assert anchor_of.setdefault(window, (int(anchor - q), int(h))) == (int(anchor - q), int(h))
    assert seen == Counter({(k, q): 1 for k, t in enumerate(texts) for q in range(len(t) - 49)})


def cut_runs(texts):
    """(text, first window, windows, anchor's place) of all runs, and digests of them."""
    keys = substrings.random_keys()
    for number, offset, buf, start in substrings.parts(texts):
        p, first, last, anchor, _ = substrings.runs(buf, start)
        d = substrings.run_digests(buf, first, last - first + substrings.LENGTH, anchor - first, keys)
        yield from zip(number[p].tolist(), (first - start[p] + offset[p]).tolist(), (last - first + 1).tolist(), (anchor - first).tolist(), d.tolist(), strict=True)


def test_digests_of_runs_tell_their_bytes_and_anchor(corpus):
    texts, seen = [(t or "").encode() for _, t in corpus], {}
    for k, at, windows, off, d in cut_runs(texts):
        run = texts[k][at : at + windows + 49], off
        assert seen.setdefault(run, d) == d
    assert len(set(seen.values())) == len(seen) > 1000


def test_windows_that_suffixes_share():
    import numpy as np

    rng = random.Random(14)
    say = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    left, gram, right = [say(30) for _ in range(4)], b"an anchor's 20 bytes", [say(30) for _ in range(4)]
    suffixes = []
    for k in range(300):
        windows = rng.randint(1, 31)
        off = rng.randint(windows - 1, 30)
        suffixes.append((rng.randint(0, 40), off, windows, ((say(30 - k % 30) + rng.choice(left)[30 - k % 30 :])[-off or 60 :] + gram + rng.choice(right)[: rng.randint(0, 30)] + say(30))[: windows + 49]))
    first = {}
    for i, off, windows, c in suffixes:
        for w in range(windows):
            first[off - w, c[w : w + 50]] = min(i, first.get((off - w, c[w : w + 50]), i))
    want = [[off - w for w in range(windows) if first[off - w, c[w : w + 50]] < i] for i, off, windows, c in suffixes]
    buf, begin = np.frombuffer(b"".join(s[3] for s in suffixes), np.uint8), np.cumsum([0, *(len(s[3]) for s in suffixes)])
    ids, off, windows = (np.array([s[k] for s in suffixes]) for k in range(3))
    most, least = substrings.repeated(substrings.sides(buf, begin, off), ids, off, windows)
    assert list(zip(most.tolist(), least.tolist(), strict=True)) == [(max(w, default=-1), min(w, default=-1)) for w in want] and sum(map(bool, want)) > 50


@pytest.mark.parametrize(("suffixes", "slice_", "docs"), [(12, 1 << 23, 4000), (60, 300, 4000), (16_384, 5000, 0)])
def test_repeated_substrings_across_borders(spark, corpus, suffixes, slice_, docs, monkeypatch):
    """Many buckets, so that equal windows are parted; small slices, so that tasks meet; anchors dealt out by digest, or not."""
    monkeypatch.setattr(substrings, "SUFFIXES", suffixes)
    monkeypatch.setattr(substrings, "SLICE", slice_)
    monkeypatch.setattr(substrings, "SAMPLE_DOCS", docs)
    monkeypatch.setattr(substrings, "SMALL", 4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(table(spark, corpus)).collect()}
    assert got == removed(corpus)


def test_one_anchor_in_every_document(spark, monkeypatch):
    """A string of 20 bytes with other surroundings in each document, some of which are shared, goes to several buckets."""
    rng = random.Random(15)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    ends = [say(40) for _ in range(30)]
    rows = [(k, say(40) + rng.choice(ends)[rng.randint(0, 12) :] + "AN ANCHOR'S 20 BYTES" + rng.choice(ends) + say(40)) for k in range(400)]
    monkeypatch.setattr(substrings, "SUFFIXES", 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(table(spark, rows)).collect()}
    want = removed(rows)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 100
    n, docs = 0, table(spark, rows).selectExpr("doc_id", "xxhash64(text) AS key", "text")
    frequent = substrings.frequent_anchors(docs)
    state = substrings.decided(substrings.packed_runs(docs, 64, frequent, substrings.random_keys()), 64, frequent)
    found = substrings.suffixes(docs, state.filter("off >= 0"))
    n = found.count()
    put = substrings.placed(found, substrings.splitters(found, n, n // 20))
    sizes = [r["count"] for r in put.filter("bucket >= 0").groupBy("bucket").count().collect()]
    assert len(frequent) and sum(sizes) == n and max(sizes) < 5 * 20


def test_substrings_of_odd_rows(spark):
    long = "0123456789" * 6
    rows = [(4, long), (4, long), (None, long), (2, None), (3, long + "x"), (8, "y" + long), (9, long), (9, "other " * 20)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substrings.digests(table(spark, rows)).collect())
    assert got == sorted([("4", 60, 60), ("4", 60, 60), ("None", 60, 0), ("2", 0, 0), ("3", 61, 0), ("8", 61, 60), ("9", 60, 60), ("9", 120, 0)])
    assert substrings.digests(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("small", [2, 64, 1000])
def test_multikey_sort(small, monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "SMALL", small)
    x = np.random.default_rng(2).integers(0, 3, (500, 4)).astype(np.uint64)
    rows = [tuple(r) for r in x[substrings.multikey(x)].tolist()]
    assert rows == sorted(map(tuple, x.tolist())) and len(substrings.multikey(x[:0])) == 0


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_scores():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 20))
        score, i, j = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist()) and 0 <= i <= j <= len(b)


def test_benchmark_items_are_found(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(300)]
    say = lambda n: rng.choices(words, k=n)
    items = {i: say(30) for i in range(12)}
    docs, want = [], set()
    for i in range(120):
        text = say(rng.randint(5, 90))
        if i % 4 == 0:
            k = i // 4 % 12
            copy = list(items[k])
            for _ in range(i % 3 * 2):
                copy[rng.randrange(len(copy))] = "edited"
            if i % 8 == 0:
                copy.insert(9, "added")
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((i, k))
        docs.append((i, ", ".join(text).title()))
    docs += [(500, None), (501, ""), (None, " ".join(items[3])), (0, docs[0][1])]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(70, "t1 t2"), (71, None), (72, "")], "item_id long, text string")
    rows = decontam.contaminated(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None} == want and {r.item_id for r in rows if r.doc_id is None} == {3}
    assert all(decontam.LEAST <= r.score <= 1 for r in rows) and len(rows) == len(want) + 2
    clean = decontam.clean(table(spark, docs), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want} - {None} and clean.columns == table(spark, docs).columns
    assert decontam.contaminated(table(spark, docs).limit(0), bench).collect() == [] and decontam.contaminated(table(spark, docs), bench.limit(0)).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BYTES", 150)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(9)]
    docs = [(k, f"before {t} after") for k, t in items]
    rows = decontam.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in rows) == [(k, k, 1.0) for k in range(9)]


def test_an_edited_passage_in_many_documents_is_found(spark):
    item = [f"a{j}" for j in range(40)]
    copy = [f"b{j}" if j % 4 == 3 else w for j, w in enumerate(item)]
    docs = [(k, " ".join([*(f"d{k}x{j}" for j in range(20)), *copy, *(f"d{k}y{j}" for j in range(20))])) for k in range(30)]
    docs += [(100 + k, " ".join(item[k : k + 3])) for k in range(1, 38, 4)]  # the lost runs occur elsewhere, once each
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = decontam.contaminated(table(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.score) for r in rows) == [(k, (30 * 2 - 9) / 80) for k in range(30)]
    assert {r.doc_id for r in decontam.clean(table(spark, docs), bench).collect()} == {i for i, _ in docs if i >= 100}


def test_every_alignment_is_tried():
    import numpy as np

    item = [f"a{j}" for j in range(15)]
    docs = [" ".join("b" if j in (3, 6, 9, 12) else w for j, w in enumerate(item)), " ".join(f"{w} b{j}" for j, w in enumerate(item))]
    rng, want, texts = random.Random(12), [{0: 22 / 30 - 4 / 30}, {0: 16 / 30}], [" ".join(item)]
    for k in range(1, 120):
        words = [f"i{k}w{rng.randrange(20)}" for _ in range(rng.randint(8, 40))]
        copy, share = [], rng.uniform(0.1, 0.6)
        for w in words:
            kind = rng.random() / share
            copy += [w] if kind > 1 else [w, "more"] if kind > 0.6 else ["other"] if kind > 0.3 else []
        texts.append(" ".join(words))
        docs.append(" ".join(["so"] * rng.randint(0, 90) + copy + ["on"] * rng.randint(0, 90)))
        score = smith_waterman(words, copy) / (2 * len(words))
        want.append({k: score} if score >= decontam.LEAST else {})
    index = decontam.Index.of(list(range(len(texts))), [t.encode() for t in texts])
    counts = np.random.default_rng(2).integers(0, 50, len(index.keys))
    h, a, b = decontam.words_of([t.encode() for t in docs], decontam.PARTS)
    got = index.seeds(counts).matches(h, a, b)
    assert [{i: s for i, s, *_ in found} for found in got] == want and 40 < sum(map(len, want)) < 100


def test_short_items_and_scripts_without_spaces(spark):
    han, thai = "今天天气很好我们去公园散步然后回家吃饭", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะ"
    items = [(1, "What is it?"), (2, "Yes"), (3, han), (4, thai), (5, "东京在哪里"), (6, "what, is it"), (7, "?!"), (8, "naïve café"), (9, "𠀀𠀁𠀂")]
    docs = [(1, "so what is it"), (2, "it is what"), (3, "what is"), (4, "(yes)"), (5, "yesterday"), (6, f"前面{han}后面"), (7, han.replace("气", "色").replace("家", "去")), (8, f"ก{thai}"), (9, "问东京在哪里吗"), (10, "东京在那里"), (11, "it"), (12, "naïve café"), (13, "naïve"), (14, "what"), (15, "is it"), (16, "今天天气"), (17, "「𠀀𠀁。𠀂」好、𠀀𠀁𠀂")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(table(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 6), (4, 2), (6, 3), (7, 3), (8, 4), (9, 5), (12, 8), (17, 9)]
    assert {r.doc_id: (r.score, r.start, r.end) for r in got if r.doc_id in (1, 6, 9)} == {1: (1.0, 1, 4), 6: (1.0, 2, 2 + len(han)), 9: (1.0, 1, 6)}
    assert {r.doc_id for r in decontam.clean(table(spark, docs), bench).collect()} == {2, 3, 5, 10, 11, 13, 14, 15, 16}


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]


@pytest.mark.parametrize(("known", "own"), [(1 << 17, 4096), (20, 5)])
def test_base_scores(spark, corpus, known, own, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", known)
    monkeypatch.setattr(hmm, "OWN", own)
    rows = [*corpus, (0, dict(corpus).get(0, "again")), (None, "w1 w2")]
    count = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    got = hmm.score(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_forward_is_the_sum_over_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    model = hmm.Model.first(np.full(7, 1 / 7))
    flat = rng.integers(0, 7, 9)
    begin = np.array([0, 4, 4 + 1, 9])
    got = model.forward(flat, begin)
    for k in range(3):
        seq, total = flat[begin[k] : begin[k + 1]], 0.0
        if len(seq) > 4:
            seq, got[k] = seq[:4], model.forward(flat[begin[k] : begin[k] + 4], np.array([0, 4]))[0]
        for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, c in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[c, b]
            total += p
        assert abs(got[k] - math.log10(total)) < 1e-9


def test_baum_welch_never_lowers_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(6)
    flat = np.concatenate([rng.integers(0, 4, 40) + 4 * (k % 2) for k in range(30)])
    begin = np.arange(0, len(flat) + 1, 40)
    prior, model, last = np.full(8, 1 / 8), hmm.Model.first(np.full(8, 1 / 8)), -math.inf
    for _ in range(6):
        counts = model.expected(flat, begin)
        k = hmm.STATES
        assert abs(counts[2 * k + k * k :].sum() - len(flat)) < 1e-6 and abs(counts[:k].sum() - 30) < 1e-6 and abs(counts[2 * k : 2 * k + k * k].sum() - 39 * 30) < 1e-6
        model = hmm.Model(*(c for c in (lambda m: (m.start, m.inner, m.move, m.emit))(model.learned(counts, prior * 1e-9))))
        now = model.forward(flat, begin).sum()
        assert now > last - 0.5
        last = now
    assert last / len(flat) > math.log10(1 / 4) - 0.1


def test_scores_beat_single_words(spark):
    rng = random.Random(9)
    langs = [[f"{p}{i}" for i in range(40)] for p in "ab"]
    rows = [(i, " ".join(rng.choices(langs[i % 2], k=50))) for i in range(300)]
    got = [r for r in hmm.score(table(spark, rows)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score > r.base_score for r in got) / len(got) > 0.9


def test_hidden_markov_of_empty_tables(spark):
    assert hmm.score(table(spark, [(1, "a")]).limit(0)).collect() == []
    alone = next(str(i) for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = hmm.score(table(spark, [(int(alone), "a b")])).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.n_tokens == 3 and math.isfinite(row.score)


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"q{i}" for i in range(30))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9000, None), (9001, ""), (9002, "12 34"), (9003, passage + " the of and"), (9004, 'and the of token = "0123456789abcdefghij" with the'), (9005, "The that with and of them"), (9005, "The that with and of them"), (None, "an with the that")]
    docs = real.unionByName(spark.createDataFrame([(i, t, None, "s", None) for i, t in odd], real.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(now.count())
        if name == "secret_scan":
            texts = {r.doc_id: r.text for r in now.collect()}
            assert "[SECRET]" in texts[9004] and not {9000, 9001, 9002, 9003} & set(texts)
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] == kept[5]
    assert all(r.round_trip for r in now.collect()) and [r.doc_id for r in now.collect()].count(9005) == 1 and None in {r.doc_id for r in now.collect()}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.n_tokens) for r in again.collect()} == {(r.doc_id, r.n_tokens) for r in now.collect()}


def test_rows_that_share_an_id_and_differ_stay(spark):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d, e = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(5))
    rows = [(1, a), (1, ""), (1, None), (2, b), (2, c), (3, d), (3, d + " more"), (3, d), (4, c + " end"), (5, None), (5, " "), (6, e), (7, e), (7, "a " + b), (None, a), (None, None)]
    got = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == table(spark, rows).columns and kept.count((None, a)) == kept.count((None, None)) == 1
    named = sorted((x for x in kept if x[0] is not None and x[0] not in (3, 5)), key=str)
    assert named == sorted([(1, a), (2, b), (2, c), (6, e)], key=str) and [i for i, _ in kept].count(3) == [i for i, _ in kept].count(5) == 1


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
