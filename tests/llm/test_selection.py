"""Importance resampling, page extraction and hard negatives against plain loops over odd tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovesift.llm import negatives, pages, resample

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_draw(docs, target, share, least, buckets, longest):
    """resample() in plain loops: {(doc_id, n_features, weight, score, rank): rows}."""

    def features(text):
        words = WORDS.findall((text or "").encode().lower())
        return [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(f) % buckets for f in features(text)[0])
    for text in target:
        t.update(zlib.crc32(f) % buckets for f in features(text)[0])
    total, aims, rows = sum(s.values()), sum(t.values()), []
    for doc, text in docs:
        found, n = features(text)
        each = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aims + buckets)))) for b in (zlib.crc32(f) % buckets for f in found)]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, n >= least and score is not None))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    drawn = share * len(able) // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    return Counter(out)


ODD = [
    (1, None), (2, ""), (3, "!? -"), (4, "a"), (5, "Ünï café 12 ABC abc"), (6, "the cat and the dog " * 30), (6, "the cat and the dog " * 30),
    (6, "another text of the same id " * 5), (None, "no id at all " * 9), (None, "no id at all " * 9), (7, "long " * 300_000), (8, "x" * 1_500_000), (-9, "the the the " * 12),
]


def test_draw_is_that_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 1000)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 7)
    docs = ODD + [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 60))) for i in range(100, 400)]
    target = ["the cat", "w1 w2 w3", None, "", "no id at all"] * 3
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("grp", F.lit("clash"))
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    for longest in (1, 3):
        rows = resample.resample(table, aims, share=10, least=20, buckets=500, longest=longest).collect()
        got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows)
        assert got == plain_draw(docs, target, 10, 20, 500, longest)


def test_draw_of_empty_tables(spark):
    none, aims = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b c",)], "text string")
    assert resample.digests(none, aims).collect() == []
    some = spark.createDataFrame(ODD, "doc_id long, text string")
    got = Counter(tuple(r) for r in resample.digests(some, aims.limit(0)).collect())
    assert got == plain_draw(ODD, [], 10, 20, 10_000, 1)


def test_a_bucket_in_every_document_is_dealt_out(spark, monkeypatch):
    """Each document has one posting for a frequent word; blocks of it meet their gain in different places."""
    monkeypatch.setattr(resample, "BLOCK_ROWS", 20)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the the the").alias("text"))
    posted = resample.postings(docs)
    places = posted.filter("grp >= 0").select(F.pmod(F.xxhash64("block"), F.lit(resample.SALTS)).alias("salt")).groupBy("salt").count().collect()
    assert len(places) > resample.SALTS // 2 and max(r["count"] for r in places) <= 12


def plain_negatives(rows, anchors, positives=5, negatives=5, low=80, high=100, scale=256):
    """mine() in plain loops: rows of (id, label, vector) to a Counter of its results."""
    taken = {(i, label, tuple(math.floor(x * scale) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for a in (r for r in taken if anchors(r[0])):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in taken if r[0] != a[0]]
        for s, i, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            held = sorted(x for x in scored if x[2] != a[1] and low * -s <= high * -x[0] <= high * -s)[:negatives]
            out.update((a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(held))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 1, 2, -3]), [rng.choice([-0.5, 0.1, 0.25, 0.7, 1.0]) for _ in range(8)]) for i in range(300)]
    rows += rows[:20] + [(i, 1, rows[10][2]) for i in range(300, 360)]  # repeated rows; many copies of one vector
    rows += [(400, 0, None), (401, None, [1.0]), (None, 1, [1.0] * 8), (402, 1, []), (403, 0, [float("nan")] * 8), (404, 0, [float("inf"), 1.0]), (405, 1, [1.0, None]), (406, 0, [9.0] * 11), (20, 2, [0.5] * 8), (500, 7, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("k", F.lit(0))
    got = Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 20 == 0).collect())
    rows = [(i, label, v and [x and float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_large_components_and_empty_tables(spark):
    """Products beyond what doubles hold exactly are multiplied as integers."""
    kind = "vec_id long, label int, embedding array<double>"
    rows = [(0, 0, [2.0**20 + 1, 3.0]), (1, 0, [2.0**21 + 1, 5.0]), (2, 1, [2.0**20 + 3, 7.0]), (3, 1, [2.0**21, 1.0]), (100, 0, [2.0**19, 11.0])]
    table = spark.createDataFrame(rows, kind)
    got = Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 100 == 0).collect())
    assert got == plain_negatives(rows, lambda i: i % 100 == 0) and got
    assert negatives.hard_negatives(table.limit(0)).collect() == []
    assert negatives.hard_negatives(table.filter("vec_id in (1, 2)")).collect() == []


def test_frequent_label_and_copies_dont_multiply_rows(spark):
    """Candidates hold one row for each tile and anchor, whatever is alike."""
    table = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"), F.expr("array(0.5, 0.5)").alias("embedding"))
    blocks = negatives.packed(negatives.quantised(table, 256).coalesce(1), negatives.ROWS)
    anchors = negatives.packed(negatives.quantised(table.filter("vec_id % 100 = 0"), 256).coalesce(1), negatives.ANCHORS)
    found = negatives.candidates(negatives.tiles(negatives.grid(anchors, blocks)), 5, 80, 100)
    assert found.count() == 30 * blocks.filter("k = 0").count() == 60
    rows = [(i, int(i % 3 == 0), [0.5, 0.5]) for i in range(3000)]
    assert Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 100 == 0).collect()) == plain_negatives(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>a<b>b</b>c<p>d", "abc d"), ("1 < 2 &lt; 3 &am", "1 < 2 < 3 &am"), ("a<br>b&nbsp;c", "a b c"),
        ('<div class="menu"><p>m</div><p title=5">x</p>', "x"), ("<article><p>t</p><article>c</article><footer>f</footer></article>", "t"), ("<head><title>x</title><body><p>y", "y"),
        ("<form><article>z</article></form><aside><article>q</article></aside>", "z"), ('<main><p>a</p><div id="user-comments"><p>no</p></div></main><p>b', "a"), ('<p>Text <span class="share">S</span> more</p>', "Text more"),
        ("<!-- <p>x --><p>y<!-- z", "y"), ("<script>var a='<p>'</SCRIPT >k<style>p{}", "k"), ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>b</article>", "T b"),
        ('<div role="alert">We use cookies</div><div class="cookie-notice">ok?</div><p>x</p><p hidden>h</p><p style="display: none">h</p>', "x"), ("<ul><li class=ad>A<li>B</ul>", "B"), ("<p>x</p><p cla", "x"),
        ("<nav>only a menu</nav>", ""), ("<form><input value='v'><select><option>o</select><button>go</button></form><table><tr><td>1<td>2</table>", "1 2"), ("<p>\x00\ud7ff</p><3 <>", "\x00\ud7ff <3 <>"),
    ],
)
def test_blocks_of_markup(page, text):
    found = pages.blocks(page)
    assert pages.kept(found, ())[0] == text and pages.unpack(pages.pack(found)) == found


def plain_text(rows):
    """main_text() over (page_id, url, html) in plain loops, by sets of runs."""
    cores, runs = {}, defaultdict(set)
    hosts = [re.sub(r"^(\w+:)?//([^/?#@]*@)?([^/?#:]*).*|.*", lambda m: m[3] or "", u or "", count=1, flags=re.S).lower() for _, u, _ in rows]
    cut = []
    for n, (_, _, page) in enumerate(rows):
        found = pages.blocks(page)
        best = max((r for r, _, _ in found), default=0)
        cores[n] = max((t for r, _, t in found if r == best), key=len, default="")
        tokens, parts = [], []
        for i, (region, mark, text) in enumerate(found):
            if region == pages.ARTICLE:
                parts.append(tokens)
                tokens = []
            else:
                tokens += [(mark | 1, i), *((w, i) for w in text.split())]
        parts.append(tokens)
        cut.append((found, best, parts))
        for p in parts:
            for k in range(max(1, len(p) - pages.RUN + 1) if p else 0):
                runs[hosts[n], tuple(t for t, _ in p[k : k + pages.RUN])].add(cores[n])
    out = []
    for n, (found, best, parts) in enumerate(cut):
        hit, size = Counter(), Counter(i for p in parts for _, i in p)
        for p in parts:
            covered = set()
            for k in range(max(1, len(p) - pages.RUN + 1) if p else 0):
                if len(runs[hosts[n], tuple(t for t, _ in p[k : k + pages.RUN])]) > 1:
                    covered |= set(range(k, min(k + pages.RUN, len(p))))
            hit.update(p[k][1] for k in covered)
        text = " ".join(t for i, (r, _, t) in enumerate(found) if r == best and best and (r == pages.ARTICLE or 2 * hit[i] <= size[i]))
        out.append((rows[n][0], rows[n][1], text, len(text), sum(hit.values())))
    return Counter(out)


def soup(rng, k, host):
    """A page without telling elements: a menu and a footer of its host around paragraphs of its own."""
    words = [rng.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(rng.randrange(50)) for _ in range(120)]
    menu = "".join(f"<div><a href=/{i}>{host} item {i}</a></div>" for i in range(6))
    own = "".join(f"<div>{' '.join(words[i : i + 40])}.</div>" for i in (0, 40, 80))
    return f"<html><body><div>{menu}</div><div>{own}</div><div>All rights of {host} are reserved by those who wrote these pages</div></body></html>", " ".join(f"{' '.join(words[i : i + 40])}." for i in (0, 40, 80))


def test_repeated_runs_of_a_host_are_removed(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for k in range(120):
        host = "big.example.org" if k % 3 else f"h{k % 4}.example.org"
        page, text = soup(rng, k, host)
        rows.append((k, f"https://user@{host.upper() if k % 2 else host}:80/{k}", page))
        truth[k] = text
    rows += [(200 + k, "http://big.example.org/copy", rows[1][2]) for k in range(40)]  # copies of a page
    truth |= {200 + k: truth[1] for k in range(40)}
    rows += [(300 + k, "http://big.example.org/edited", rows[4][2].replace(truth[4].split(". ")[0], f"Edited opening number {k}")) for k in range(5)]
    rows += [(400, None, None), (401, "", ""), (402, "no address", "<p>x"), (403, "//lone.example.org", rows[7][2]), rows[5], rows[5]]
    rows.append((500, "http://big.example.org/long", "<p>" + "very long text " * 100_000 + "</p>" + "<b>" * 2000))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("core", F.lit(1))
    got = [tuple(r) for r in pages.main_text(table).collect()]
    assert Counter(got) == plain_text(rows)
    texts = {r[0]: r[2] for r in got}
    assert all(texts[k] == v for k, v in truth.items()), "menus and footers go, whole articles and their copies stay"
    assert texts[403].startswith("big.example.org item 0") and texts[500].count("very") == 100_000


def test_main_text_of_the_tables_is_the_article(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in pages.main_text(table).collect()]
    assert Counter(got) == plain_text(rows)
    articles = {i: re.search("<article>(.*)</article>", page, re.S)[1] for i, _, page in rows}
    truth = {i: " ".join(html.unescape(re.sub("</?(h1|p|br)>", " ", a).replace("<b>", "").replace("</b>", "")).split()) for i, a in articles.items()}
    assert {r[0]: r[2] for r in got} == truth


def test_main_text_keeps_what_no_run_tells_of(spark):
    """headlines behind a menu, text outside a main part that is all boilerplate, and what stands in it beside the article."""
    rng = random.Random(8)
    own = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(900)) for _ in range(n))
    menu = "".join(f"<div>Section number {i}</div>" for i in range(8))
    notice, foot = "Readers of this house are asked to mind the rules of the house at all times", "All rights of this house are reserved by those who wrote these pages"
    rows, truth = [], {}
    for k in range(40):
        title, by, body, more = f"How to bake {own(1)}", f"By {own(1)} Smith", own(60), own(30)
        if k % 4 == 0:  # a headline whose first words, and a line whose last ones, are those of other pages
            page, truth[k] = f"<div>{menu}</div><h1>{title}</h1><p>{body}</p><p>{by}</p><div>{foot}</div>", f"{title} {body} {by}"
        elif k % 4 == 1:  # the main part is a notice
            page, truth[k] = f"<div>{menu}</div><main><p>{notice}</p></main><p>{body}</p><div>{foot}</div>", body
        elif k % 4 == 2:  # which other pages have above their text
            page, truth[k] = f"<main><p>{notice}</p><p>{body}</p></main>", body
        else:  # a headline and a second part beside the article
            page, truth[k] = f"<div>{menu}</div><main><h1>{title}</h1><article><p>{body}</p></article><p>{notice}</p><p>{more}</p></main><p>{by}</p><div>{foot}</div>", f"{title} {body} {more}"
        rows.append((k, "http://house.example.org/", page))
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == truth and all(r.n_chars == len(r.text) and r.n_repeated > 0 for r in got.values())


def test_kept_is_that_of_a_plain_loop():
    """a run tells of the blocks that it lies in or holds whole, in its stretch."""
    rng = random.Random(9)
    for _ in range(400):
        found = [(rng.choice([0, 1, 1, 2, 2, 3]), rng.randrange(9), " ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 9, 10, 25])))) for _ in range(rng.randrange(8))]
        codes, of = pages.stream(found)
        parts = [(int(a), int(b)) for a, b in pages._runs(codes)]
        places = [k for a, b in parts for k in range(a, max(a, b - pages.RUN) + 1) if rng.random() < 0.3]
        blocks = {i: {k for k in range(len(of)) if of[k] == i} for i in set(of.tolist()) - {-1}}
        every, told = set(), set()
        for k in places:
            run = set(range(k, min(k + pages.RUN, next(b for a, b in parts if a <= k < b))))
            every |= run
            told |= {x for own in blocks.values() if run <= own or own <= run for x in run & own}
        left = [(r, w) for i, (r, _, w) in enumerate(found) if r == 3 or (r and 2 * len(told & blocks[i]) <= len(blocks[i]))]
        best = min(2, max((r for r, _ in left), default=0))
        assert pages.kept(found, places) == (" ".join(w for r, w in left if r >= best), len(every))


def test_main_text_of_an_empty_table(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
