import random

import pytest
from pyspark.sql import functions as F

from grovesift.operators import forest, reconcile
from grovesift.operators.search import Request, matches, respond, search, search_or_nothing
from grovesift.operators.trigrams import appended, candidates, index_bytes, lookup, postings
from grovesift.plans.compile import to_column
from grovesift.plans.patterns import FOLDED_FROM_AFAR, compiled

# A store of goods: two folders with one more below, and files of odd names.
ROWS = [
    (0, None, "/", 0, 100, True), (10, 0, "EUROPE", 0, 101, True), (11, 0, "Asia", 0, 102, True), (12, 11, "Nation_9", 0, 103, True),
    (20, 10, "Parts List.CSV", 1200, 200, False), (21, 10, "parts-old.csv.gz", 300, 201, False), (22, 11, "Île-de-Ré.map", 45, 202, False), (23, 12, "part_7.csv", 1200, 203, False),
    (24, 12, "README", 1, 204, False), (25, 0, "counterparts.txt", 9000, 205, False),
]
FILES = [r[0] for r in ROWS if not r[5]]


@pytest.fixture(scope="module")
def files(spark):
    rows = spark.createDataFrame([(*r, 1, True) for r in ROWS], "id long, parent long, name string, size long, mtime long, is_dir boolean, vol_id int, is_live boolean")
    return forest.build(rows).cache()


@pytest.mark.parametrize(
    ("text", "options", "ids"),
    [
        ("", {}, [r[0] for r in ROWS]), ("part", {}, [20, 21, 23, 25]), ("part", {"whole_word": True}, [23]), ("parts", {"whole_word": True}, [20, 21]), ("part*", {"whole_word": True}, [20, 21, 23]),
        ("Parts", {"ignore_case": False}, [20]), ("*.csv", {}, [20, 23]), ("part?7*", {}, [23]), ("île", {}, [22]), ("ÎLE", {}, [22]), ("ÎLE", {"ignore_case": False}, []),
        (r"path:asia\nation", {}, [12, 23, 24]), ("asia csv", {"match_path": True}, [23]), ("asia/*/part*", {"match_path": True}, []), ("*asia/*part*", {"match_path": True}, [23]),
        ("in:/asia", {}, [11, 12, 22, 23, 24]), ("in:/asia", {"ignore_case": False}, []), ("in:/Asi", {}, []), ("in:/", {"ignore_case": False}, [r[0] for r in ROWS]),
        ("ext:csv,map", {}, [20, 22, 23]), ("ext:gz", {}, [21]), ("ext:readme", {}, []), ("type:folder", {}, [0, 10, 11, 12]), ("size:1200", {}, [20, 23]), ("size:<1kb type:file", {}, [21, 22, 24]),
        ("modified:1970-01-01 type:file", {}, FILES), ("NOT ext:csv type:file", {}, [21, 22, 24, 25]), ("ext:csv XOR parts", {}, [21, 23, 25]), ("in:/EUROPE OR size:1", {}, [10, 20, 21, 24]),
        ("in:/Asia (ext:map OR part) NOT in:/Asia/Nation_9", {}, [22]), ("/in /Asia /in /Asia/Nation_9", {}, [12, 23, 24]), ("/in /Africa part", {}, []), ("/not europe part", {}, [23, 25]),
        ("/filetype csv parts /or part_", {}, [20, 23]), ("/filetype map /or readme", {}, [22, 24]), ("/type file /size >=1200 /filetype csv", {}, [20, 23]), ("/regex ^part[^s]", {}, [23]),
        ("[ds]-old|^readme$", {"pattern_mode": True}, [21, 24]), ("regex:^PART", {"ignore_case": False}, []), ("rx:[[:digit:]]", {}, [12, 23]), (r"regex:\.csv$", {}, [20, 23]),
        (r"rx:\x50arts", {}, [20, 21, 25]), (r'rx:"\QParts L\E"', {}, [20]), ("rx:/asia/n", {"match_path": True}, [12, 23, 24]),
    ],
)
def test_matches(files, text, options, ids):
    assert sorted(r.id for r in matches(files, Request(text, **options)).select("id").collect()) == sorted(ids)


def test_paths_and_counts(files, spark):
    assert {r.id: (r.path, r.depth) for r in files.collect()}[23] == ("/Asia/Nation_9/part_7.csv", 3)
    assert forest.counts(files).first().asDict() == {"live": 10, "deleted": 0, "folders": 4, "bytes": 11_746}
    assert forest.needs_compaction(900_000, 100_000) and not forest.needs_compaction(900_001, 99_999) and not forest.needs_compaction(2_000_000, 200_000)
    paths = spark.createDataFrame([("/Asia/Nation_9",), ("/asia",), ("/Asia/none",), ("/",)], "path string")
    assert {tuple(r) for r in reconcile.resolve(files, paths).collect()} == {("/Asia/Nation_9", 12), ("/", 0)}
    assert {r.id for r in reconcile.children(files, 11).collect()} == {12, 22} and [r.id for r in reconcile.children(files, 12, "README").collect()] == [24] and reconcile.children(files, 12, "readme").count() == 0


@pytest.mark.parametrize("key", ["name", "path", "size", "mtime", "kind"])
def test_orders_turn_round_whole(files, key):
    up = [r.id for r in search(files, Request("", sort=key)).collect()]
    assert [r.id for r in search(files, Request("", sort=key, ascending=False)).collect()] == up[::-1]
    assert [r.id for r in search(files, Request("", sort=key, limit=3)).collect()] == up[:3]


def test_kind_order(files):
    assert [r.id for r in search(files, Request("", sort="kind")).collect()] == [0, 11, 10, 12, 24, 23, 20, 21, 22, 25]


def test_natural_order_of_numbers_of_any_length(spark):
    from grovesift.functions.text import natural_key

    rng = random.Random(4)
    numbers = [0, 7, 9, 10, 99, 100, 10**19, 10**20, 10**24, 5 * 10**24, 10**25, 10**120, *(rng.randrange(10 ** rng.randint(1, 40)) for _ in range(60))]
    names = spark.createDataFrame([(str(n), f"/Part-{'0' * (k % 3)}{n}.x") for k, n in enumerate(numbers)], "n string, name string")
    got = [int(r.n) for r in names.orderBy(natural_key(F.col("name"))).collect()]
    assert got == sorted(numbers)


def test_answers(files):
    assert respond(files, Request("type:file", limit=6))["truncated"] is False
    answer = respond(files, Request("type:file limit:4"))
    assert answer["truncated"] is True and answer["returnedCount"] == 4
    assert search_or_nothing(files, Request("part OR")).collect() == [] and search_or_nothing(files, Request("part")).count() == 4


def test_top_k_is_pushed_into_tasks(files):
    plan = search(files, Request("part"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan


def test_name_tests_reach_the_scan(files, spark, tmp_path):
    files.write.parquet(str(tmp_path / "f"))
    plan = matches(spark.read.parquet(str(tmp_path / "f")), Request("part size:>5")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name_fold,part)" in plan and "GreaterThanOrEqual(size,6)" in plan


def test_patterns_test_their_plain_part_first(files, spark, tmp_path):
    files.write.parquet(str(tmp_path / "f"))
    plan = lambda q: matches(spark.read.parquet(str(tmp_path / "f")), Request(q)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name_fold,.gz)" in plan(r"regex:\.GZ$") and "StringContains(name_fold,part)" in plan("regex:parts") and "StringContains" not in plan("regex:read|s.k")
    assert "Or(StringContains(name_fold,read),StringContains(name_fold,part))" in plan("regex:read|part")


def test_letters_that_fold_from_afar(spark):
    """All code points beyond ASCII, against every letter."""
    letters = [chr(c) for c in range(97, 123)]
    beyond = spark.range(128, 0x110000).filter("not id between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = beyond.filter(F.col("c").rlike("(?iu)[a-z]")).agg(F.collect_list("c").alias("every"), *(F.max(F.col("c").rlike(f"(?iu){letter}")).alias(letter) for letter in letters)).first()
    assert {letter for letter in letters if found[letter]} == FOLDED_FROM_AFAR and "ı" in found.every


def test_the_plain_part_of_a_pattern_changes_no_answer(spark):
    rng = random.Random(11)
    parts = ["abc", "Liman", "x1", "\\.", ".", "a?", "b+", "c*", "[a-c]", "[^x]", "[[:alpha:]]", "\\d", "\\w+", "\\x41", "\\Qab\\E", "(ab)", "(?:b)", "^", "$", "d{2}", "e{0}", "\\-", "\\b", "\\p{L}", "[a[bc]]", "[]a]", "\\cA", "li", "\\u0061", "k"]
    names = ["Liman.txt", "lıman", "LİMAN.x", "abc", "Abcd", "xx1abc", "41bcd", "a.b-c", "ddabc", "Kabc", "e", "aab", "Qab", "]abc", "x41", "\x01abc", "abıc"]
    names += ["".join(rng.choice(["a", "b", "c", "d", "x1", "Li", "man", ".", "-", "A", "41", "ı"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    rows = forest.with_folds(spark.createDataFrame([(k, n, "/" + n) for k, n in enumerate(names)], "id long, name string, path string").withColumn("is_live", F.lit(True))).cache()
    tried, literal, wrong = [], 0, []
    for k in range(90):
        pattern = "".join(rng.choice(parts if k % 2 else parts[:12]) for _ in range(rng.randint(1, 5)))
        try:
            request = Request(f'regex:"{pattern}"', ignore_case=rng.random() < 0.6)
            tree = request.plan.tree
        except ValueError:
            continue
        found = compiled(tree.regex, request.ignore_case)
        literal += found.need is not None
        wrong.append(F.count_if(to_column(tree, request.options) != F.col("name").rlike(found.java)))
        tried.append(pattern)
    got = [n for k in range(0, len(wrong), 15) for n in rows.agg(*wrong[k : k + 15]).first()]
    assert [p for p, n in zip(tried, got, strict=True) if n] == [] and len(tried) > 60 and literal > 10


def test_compaction_and_orphans(files):
    out = forest.compacted(files.withColumn("is_live", F.col("id") != 11)).orderBy("id").collect()
    assert [(r.id, r.parent, r.path) for r in out] == [(0, None, "/"), (1, 0, "/EUROPE"), (2, 1, "/EUROPE/Parts List.CSV"), (3, 1, "/EUROPE/parts-old.csv.gz"), (4, 0, "/counterparts.txt")]
    assert forest.counts(files.withColumn("is_live", F.col("id") != 25)).first().asDict() == {"live": 9, "deleted": 1, "folders": 4, "bytes": 2746}


def test_trigram_index(files):
    index = postings(files.filter("id < 23"))
    index = appended(index, files, 23)
    assert sorted(r.id for r in lookup(files, index, "PARTS").collect()) == [20, 21, 25]
    assert candidates(index, "pa") is None and candidates(index, "île") is None
    assert sorted(r.id for r in lookup(files.withColumn("is_live", F.col("id") != 25), index, "parts").collect()) == [20, 21]
    assert index_bytes(index).first().bytes == 11 * index.count() and index_bytes(index.limit(0)).first().bytes == 0


def test_empty_table(files):
    assert search(files.limit(0), Request("part")).collect() == []
    assert forest.counts(files.limit(0)).first().bytes == 0
