"""Registered queries of the search engine over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .functions.text import canonical_column, extension, glob_pattern, natural_key, quote, rfc3339, trigrams, whole_word_pattern
from .operators import forest, reconcile, rules, trigrams as index
from .operators.search import Request, matches, matches_of, order, search, symmetric_difference, union
from .sources import changelog, sinks
from .sources.snapshots import SnapshotStore
from .streaming import changes

NOW = datetime(1999, 1, 1, tzinfo=UTC)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FILES = f"""
WITH r AS (SELECT *, '/' || r_name AS path FROM region),
n AS (SELECT n_nationkey, n_name, n_regionkey, r.path || '/' || n_name AS path FROM nation JOIN r ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, c_name, c_nationkey, n.path || '/' || c_name AS path FROM customer JOIN n ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, o_custkey, 'order-' || o_orderkey || '.' || lower(o_orderstatus) AS name, c.path,
  floor(o_totalprice)::BIGINT AS size, epoch(o_orderdate)::BIGINT AS mtime FROM orders JOIN c ON o_custkey = c_custkey),
plain AS (
  SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, '/' AS name, '/' AS path, 0 AS depth, 0::BIGINT AS size, 0::BIGINT AS mtime, true AS is_dir
  UNION ALL SELECT 1 + r_regionkey, 0, r_name, path, 1, 0, 0, true FROM r
  UNION ALL SELECT 1000 + n_nationkey, 1 + n_regionkey, n_name, path, 2, 0, 0, true FROM n
  UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, c_name, path, 3, 0, 0, true FROM c
  UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, name, path || '/' || name, 4, size, mtime, false FROM o),
files AS (SELECT *, 1 AS vol_id, translate(name, '{UPPER}', '{LOWER}') AS name_fold, translate(path, '{UPPER}', '{LOWER}') AS path_fold,
  translate(regexp_extract(name, '(?s)^.+\\.([^.]*)$', 1), '{UPPER}', '{LOWER}') AS ext FROM plain)
"""
RECORD = "id, name, path, parent, size, mtime, is_dir, vol_id"
YEAR = (int(datetime(1998, 1, 1, tzinfo=UTC).timestamp()), int(datetime(1999, 1, 1, tzinfo=UTC).timestamp()) - 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def files(spark: SparkSession, folder: str) -> DataFrame:
    return forest.from_sales(spark, folder)


def filtered(name: str, text: str, where: str, **options) -> None:
    """A query whose whole match set is the result."""
    request = Request(text, now=NOW, **options)
    register(name, lambda s, d: matches(files(s, d), request).select(*forest.RECORD), f"{FILES} SELECT {RECORD} FROM files WHERE {where}")


def ranked(name: str, text: str, where: str, sort: str, keys: str, ascending: bool = True, limit: int = 50, **options) -> None:
    """A query with an order and a limit, both of them its feature."""
    request = Request(text, now=NOW, sort=sort, ascending=ascending, limit=limit, **options)
    register(name, lambda s, d: search(files(s, d), request), f"{FILES} SELECT {RECORD} FROM files WHERE {where} ORDER BY {keys} LIMIT {request.most}")


# Leaves.
filtered("all_rows", "", "true")
filtered("text_ci", "ORDER-1", "contains(name_fold, 'order-1')")
filtered("text_cs", "Customer", "contains(name, 'Customer')", ignore_case=False)
filtered("glob_anchored", "order-1*.f", "regexp_full_match(name_fold, 'order-1.*\\.f', 's')")
filtered("glob_one", "order-?.f", "regexp_full_match(name_fold, 'order-.\\.f', 's')")
filtered("path_text", "path:ASIA\\nation", "contains(path_fold, 'asia/nation')")
filtered("match_path_multi", "asia order-2", "contains(path_fold, 'asia') AND contains(path_fold, 'order-2')", match_path=True)
filtered("match_path_glob", "name:/asia/*order-1*", "regexp_full_match(path_fold, '/asia/.*order-1.*', 's')", match_path=True)
filtered("dir_subtree", "in:/ASIA", "path = '/ASIA' OR starts_with(path, '/ASIA/')")
filtered("dir_root", "in:/", "true")
filtered("filetype_list", "filetype:F,p", "ext IN ('f', 'p')")
filtered("regex_name", "regex:^order-[0-9]{2}\\.", "regexp_matches(name, '^order-[0-9]{2}\\.')")
filtered("regex_posix", "rx:^order-[[:digit:]]+\\.o$", "regexp_matches(name, '^order-[0-9]+\\.o$')")
filtered("regex_mode", "^customer#0+1$", "regexp_matches(name_fold, '^customer#0+1$')", pattern_mode=True)
filtered("kind_folder", "type:folder", "is_dir")
filtered("kind_file", "type:files", "NOT is_dir")
filtered("size_range", "size:100kb..200kb", "size BETWEEN 102400 AND 204800")
filtered("size_over", "size:>300000", "size > 300000")
filtered("size_most", "size:<=1.5kb type:file", "size <= 1536 AND NOT is_dir")
filtered("modified_range", "modified:1998-01-01..1998-12-31", f"mtime BETWEEN {YEAR[0]} AND {YEAR[1]}")
filtered("modified_since", "modified:200d", f"mtime >= {int(NOW.timestamp()) - 200 * 86400}")
filtered("modified_day", "modified:1997-06-01", f"mtime BETWEEN {int(datetime(1997, 6, 1, tzinfo=UTC).timestamp())} AND {int(datetime(1997, 6, 2, tzinfo=UTC).timestamp()) - 1}")
# The Boolean tree.
filtered("bool_and", "ext:f AND size:>200kb AND in:/EUROPE", "ext = 'f' AND size > 204800 AND starts_with(path, '/EUROPE/')")
filtered("bool_or", "ext:p OR name:nation", "ext = 'p' OR contains(name_fold, 'nation')")
filtered("bool_xor", "filetype:f XOR order-1", "(ext = 'f') <> contains(name_fold, 'order-1')")
filtered("xor_chain", "ext:f XOR order-1 XOR type:folder", "((ext = 'f') <> contains(name_fold, 'order-1')) <> is_dir")
filtered("bool_not", "NOT filetype:f", "ext <> 'f'")
filtered("bool_nested", "in:/AMERICA (ext:o OR (order-7 NOT ext:f)) NOT size:<50kb", "starts_with(path, '/AMERICA/') AND (ext = 'o' OR (contains(name_fold, 'order-7') AND ext <> 'f')) AND size >= 51200")
# Slash syntax.
filtered("slash_or_groups", "/filetype f order-1 /or order-22", "(contains(name_fold, 'order-1') OR contains(name_fold, 'order-22')) AND ext = 'f'")
filtered("slash_or_types", "/filetype p /or order-3", "ext = 'p' OR contains(name_fold, 'order-3')")
filtered("slash_not_path", "/not asia order-1", "contains(name_fold, 'order-1') AND NOT contains(path_fold, 'asia')")
filtered("slash_refined", "/type file /size >100kb /modified 1998-01-01..1998-12-31 /in /AFRICA", f"NOT is_dir AND size > 102400 AND mtime BETWEEN {YEAR[0]} AND {YEAR[1]} AND starts_with(path, '/AFRICA/')")
filtered("slash_regex", "/filetype f /regex ^order-1[0-9]*\\.f$", "regexp_matches(name, '^order-1[0-9]*\\.f$')")
# Orders and limits.
ranked("topk_name", "type:file", "NOT is_dir", "name", "name_fold, path, id")
ranked("topk_name_desc", "type:file", "NOT is_dir", "name", "name_fold DESC, path DESC, id DESC", ascending=False)
ranked("topk_size", "ext:f", "ext = 'f'", "size", "size, id")
ranked("topk_size_desc", "ext:f", "ext = 'f'", "size", "size DESC, id DESC", ascending=False)
ranked("topk_mtime", "in:/ASIA type:file", "starts_with(path, '/ASIA/') AND NOT is_dir", "mtime", "mtime, id")
ranked("topk_kind", "", "true", "kind", "NOT is_dir, ext, name_fold, id", limit=3000)
ranked("limit_directive", "order-1 limit:7", "contains(name_fold, 'order-1')", "name", "name_fold, path, id")
# By runs of digits and of other characters; digits as numbers, which come before letters as they do in a key.
_RUNS = "list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN {'t': '1', 'n': t::HUGEINT} ELSE {'t': t, 'n': 0::HUGEINT} END)"
register(
    "sort_path_natural", lambda s, d: search(files(s, d), Request("order-1", sort="path", limit=200)),
    f"{FILES} SELECT {RECORD} FROM files WHERE contains(name_fold, 'order-1') ORDER BY {_RUNS}, path, id LIMIT 200",
)
# By collation: words that differ in accents or case only are as one word before the number behind them.
_WORDS = {"Äpfel": "apfel", "apfel": "apfel", "Éclair": "eclair", "eclair": "eclair", "zebra": "zebra", "Zoo": "zoo", "öl": "ol"}
_WORD_SQL = lambda words: f"list_extract([{', '.join(repr(w) for w in words)}], (id % {len(_WORDS)})::INT + 1)"


def _accented(spark: SparkSession, folder: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("id") % len(_WORDS) + 1).cast("int"))
    return forest.with_folds(files(spark, folder).withColumn("path", F.concat(F.lit("/"), word, F.lit("/"), F.col("id").cast("string"))))


register(
    "sort_path_collated", lambda s, d: search(_accented(s, d), Request("type:file", sort="collated", limit=900)).select("id", "path"),
    f"{FILES} SELECT id, '/' || {_WORD_SQL(_WORDS)} || '/' || id AS path FROM files WHERE NOT is_dir ORDER BY {_WORD_SQL(_WORDS.values())}, id LIMIT 900",
)
register(
    "natural_keys", lambda s, d: files(s, d).select("id", natural_key(F.col("path")).alias("k")),
    f"""{FILES} SELECT id, array_to_string(list_transform(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN t::HUGEINT::VARCHAR ELSE t END),
  lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN length(length(t)::VARCHAR) || length(t)::VARCHAR || t ELSE t END), '') AS k FROM files""",
)
# Sets of ids.
_A, _B = Request("ext:f"), Request("order-1")
register("ids_union", lambda s, d: union(matches(files(s, d), _A), matches(files(s, d), _B)), f"{FILES} SELECT id FROM files WHERE ext = 'f' OR contains(name_fold, 'order-1')")
register("ids_symmetric", lambda s, d: symmetric_difference(matches(files(s, d), _A), matches(files(s, d), _B)), f"{FILES} SELECT id FROM files WHERE (ext = 'f') <> contains(name_fold, 'order-1')")
# Words and text of the part and document tables.
register("whole_word", lambda s, d: s.read.parquet(f"{d}/part.parquet").filter(F.col("p_name").rlike("(?iu)" + whole_word_pattern("ring"))).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)(^|[^\\pL\\pM\\pN])ring($|[^\\pL\\pM\\pN])')")
register("document_word", lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter(F.col("text").rlike(whole_word_pattern("été"))).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\pL\\pM\\pN])été($|[^\\pL\\pM\\pN])')")
register("part_glob", lambda s, d: s.read.parquet(f"{d}/part.parquet").filter(F.lower("p_name").rlike(glob_pattern("*ring?*"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_name), '.*ring..*', 's')")
filtered("whole_word_name", "CUSTOMER", "regexp_matches(name, '(?i)(^|[^\\pL\\pM\\pN])customer($|[^\\pL\\pM\\pN])')", whole_word=True)
register("document_accents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter(F.col("text").rlike(whole_word_pattern("für"))).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\pL\\pM\\pN])für($|[^\\pL\\pM\\pN])')")
register("part_ring_glob", lambda s, d: s.read.parquet(f"{d}/part.parquet").filter(F.lower("p_name").rlike(glob_pattern("*d ?i*"))).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(lower(p_name), '.*d .i.*', 's')")
# Patterns whose plain part must not be tested first: escapes, and letters that fold to characters beyond ASCII.
filtered("regex_escape", r"regex:\x6frder-1", "contains(name_fold, 'order-1')")
_DOTLESS = {0: "lıman", 1: "LİMAN", 2: "Liman", 3: "limon"}
register(
    "regex_dotless", lambda s, d: matches(forest.with_folds(files(s, d).withColumn("name", F.concat(F.element_at(F.array(*map(F.lit, _DOTLESS.values())), (F.col("id") % 4 + 1).cast("int")), F.lit("-"), "name"))), Request("regex:^liman-")).select("id", "name"),
    f"{FILES} SELECT id, CASE id % 4 WHEN 0 THEN 'lıman' WHEN 1 THEN 'LİMAN' ELSE 'Liman' END || '-' || name AS name FROM files WHERE id % 4 <> 3",
)
# Patterns beyond ASCII, over orders whose names begin with words of several scripts; alternatives.
_SCRIPTS = ("über", "naïve", "x٣", "Ελλάδα", "a-b", "日本1")
_NAME_SQL = f"CASE id % {len(_SCRIPTS)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_SCRIPTS)) + " END || '_' || name"


def _scripts(spark: SparkSession, folder: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("id") % len(_SCRIPTS) + 1).cast("int"))
    return forest.with_folds(files(spark, folder).withColumn("name", F.concat(word, F.lit("_"), "name")))


def scripted(name: str, text: str, where: str, **options) -> None:
    request = Request(text, now=NOW, **options)
    register(name, lambda s, d: matches(_scripts(s, d), request).select("id", "name"), f"{FILES}, named AS (SELECT id, {_NAME_SQL} AS name FROM files) SELECT id, name FROM named WHERE {where}")


scripted("regex_unicode_words", r"regex:^\w+-\d+\.[fo]$", r"regexp_matches(name, '^[\pL\pM\p{Nd}_]+-\p{Nd}+\.[fo]$')")
scripted("regex_unicode_digits", r"regex:^\D*[[:digit:]]_", r"regexp_matches(name, '^\P{Nd}*\p{Nd}_')")
scripted("regex_unicode_borders", r'regex:"\b(b|ÜBER)_ORDER\b"', "contains(name, '-b_order-') OR starts_with(name, 'über_order-')")
scripted("regex_alternatives", r'regex:"(order-1|nation_2|customer#0+)[0-9]*\.?"', "contains(name, 'order-1') OR regexp_matches(name, '(?i)nation_2|customer#0')")
# Counts, kinds and times.
register("counts_status", lambda s, d: forest.counts(files(s, d)), f"{FILES} SELECT count(*) AS live, 0::BIGINT AS deleted, count(*) FILTER (is_dir) AS folders, sum(size)::BIGINT AS bytes FROM files")
register("truncated_flag", lambda s, d: matches(files(s, d), _B).select("id").limit(101).agg(F.least(F.count("*"), F.lit(100)).alias("returned"), (F.count("*") > 100).alias("truncated")), f"{FILES} SELECT least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM files WHERE contains(name_fold, 'order-1')")
register("extensions", lambda s, d: files(s, d).groupBy(extension(F.col("name")).alias("ext")).agg(F.count("*").alias("n")), f"{FILES} SELECT ext, count(*) AS n FROM files GROUP BY ext")
register("json_lines", lambda s, d: sinks.json_rows(files(s, d)).select(F.get_json_object("json", "$.path").alias("path"), F.get_json_object("json", "$.modified").alias("modified")), f"{FILES} SELECT path, CASE WHEN id <> 0 THEN strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS modified FROM files")
register("json_lines_whole", lambda s, d: sinks.json_rows(files(s, d)).select(*[F.get_json_object("json", f"$.{k}").alias(k.lower()) for k in ("name", "path", "isDirectory", "size", "modified")]), f"{FILES} SELECT name, path, CASE WHEN is_dir THEN 'true' ELSE 'false' END AS isdirectory, CASE WHEN id <> 0 THEN size::VARCHAR END AS size, CASE WHEN id <> 0 THEN strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS modified FROM files")
register("rfc3339_times", lambda s, d: files(s, d).select("id", rfc3339(F.col("mtime")).alias("at")), f"{FILES} SELECT id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM files")
register("tsv_rows", lambda s, d: sinks.tsv_rows(files(s, d)), f"""{FILES} SELECT concat_ws(chr(9), name, path, CASE WHEN is_dir THEN '' ELSE size::VARCHAR END,
  CASE WHEN is_dir THEN 'Folder' WHEN ext = '' THEN 'File' ELSE upper(ext) || ' File' END, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S')) AS line FROM files""")
# The forest.
register("recursive_paths", lambda s, d: forest.build(files(s, d).drop("path", "depth")).select("id", "path", "depth"), f"""{FILES.replace("WITH r AS", "WITH RECURSIVE r AS")},
walk AS (SELECT id, name AS path, 0 AS depth FROM plain WHERE parent IS NULL
  UNION ALL SELECT p.id, CASE WHEN w.path = '/' THEN '/' || p.name ELSE w.path || '/' || p.name END, w.depth + 1 FROM plain p JOIN walk w ON p.parent = w.id)
SELECT id, path, depth FROM walk""")


def _chains(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as folders within each other: each one in the order before it, from every 2,000th key on a new tree."""
    key, block = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2000)
    before = F.lag("o_orderkey").over(Window.partitionBy(block).orderBy("o_orderkey"))
    name = F.when(before.isNull(), F.concat(F.lit("/"), block.cast("string"))).otherwise((key % 10).cast("string"))
    off = F.lit(0).cast("long")
    return spark.read.parquet(f"{folder}/orders.parquet").select(key.cast("long").alias("id"), before.cast("long").alias("parent"), name.alias("name"), off.alias("size"), off.alias("mtime"), F.lit(True).alias("is_dir"), F.lit(1).alias("vol_id"), F.lit(True).alias("is_live"))


register("deep_paths", lambda s, d: forest.build(_chains(s, d)).select("id", "depth", F.length("path").alias("long"), F.md5(F.col("path").cast("binary")).alias("digest")), """
WITH o AS (SELECT o_orderkey AS id, o_orderkey // 2000 AS block, row_number() OVER (PARTITION BY o_orderkey // 2000 ORDER BY o_orderkey) - 1 AS depth FROM orders),
p AS (SELECT id, depth, string_agg(CASE WHEN depth = 0 THEN '/' || block ELSE (id % 10)::VARCHAR END, '/') OVER (PARTITION BY block ORDER BY id) AS path FROM o)
SELECT id, depth::INTEGER AS depth, length(path)::INTEGER AS long, md5(path) AS digest FROM p""")


def _tombstoned(spark: SparkSession, folder: str) -> DataFrame:
    gone = (F.col("id") % 7 == 3) & (F.col("depth") >= 2)
    return files(spark, folder).withColumn("is_live", ~gone)


_LIVE = "t AS (SELECT *, NOT (id % 7 = 3 AND depth >= 2) AS is_live FROM files), p AS (SELECT a.* FROM t a WHERE a.is_live AND NOT EXISTS (SELECT 1 FROM t b WHERE NOT b.is_live AND starts_with(a.path, b.path || '/')))"
register("compacted", lambda s, d: forest.compacted(_tombstoned(s, d)).select("id", "parent", "path"), f"""{FILES}, {_LIVE},
q AS (SELECT row_number() OVER (ORDER BY id) - 1 AS new, * FROM p) SELECT q.new AS id, u.new AS parent, q.path FROM q LEFT JOIN q u ON q.parent = u.id""")


register("counts_deleted", lambda s, d: forest.counts(_tombstoned(s, d)), f"{FILES}, {_LIVE} SELECT count(*) FILTER (is_live) AS live, count(*) FILTER (NOT is_live) AS deleted, count(*) FILTER (is_live AND is_dir) AS folders, sum(size) FILTER (is_live)::BIGINT AS bytes FROM t")
register("resolved_paths", lambda s, d: reconcile.resolve(_tombstoned(s, d), s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("/ASIA/"), "n_name").alias("path"))), f"{FILES}, {_LIVE} SELECT path, id FROM t WHERE is_live AND path IN (SELECT '/ASIA/' || n_name FROM nation)")


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Saved, changed in some rows, and loaded."""
    store, rows = SnapshotStore(spark, f"{scratch.folder(spark)}/stores/{uuid.uuid4().hex}"), _tombstoned(spark, folder)
    store.save(rows, "f", 1)
    store.append(rows.filter("is_live and id % 5 = 1").withColumns({"size": F.col("size") + 7, "is_live": F.col("id") % 2 == 0}), 2)
    return store.load()[0].select("id", "path", "size")


register("snapshot_round_trip", _round_trip, f"{FILES}, {_LIVE} SELECT id, path, size + CASE WHEN id % 5 = 1 THEN 7 ELSE 0 END AS size FROM t WHERE is_live AND NOT (id % 5 = 1 AND id % 2 = 1)")


# The parts of a stored table that some folders touch: the rows of customers who have events, and all their orders.
def _skipping(spark: SparkSession, folder: str) -> DataFrame:
    store = SnapshotStore(spark, f"{scratch.folder(spark)}/stores/{uuid.uuid4().hex}", rows_per_file=2000)
    rows = files(spark, folder)
    store.save(rows, "f", 1)
    users = spark.read.parquet(f"{folder}/events.parquet").select((1_000_000 + F.col("user_id")).alias("id")).distinct()
    named = rows.join(users, "id", "left_semi").select("id", "path")
    near = store.near(named.select("path", F.explode(F.array(F.lit("row"), F.lit("children"))).alias("what")))
    own = near.join(named.select("id"), "id", "left_semi").select("id", "path")
    return own.unionByName(near.join(named.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "path"))


register("batch_skipping", _skipping, f"{FILES}, u AS (SELECT DISTINCT 1000000 + user_id AS id FROM events) SELECT id, path FROM files WHERE id IN (SELECT id FROM u) OR (depth = 4 AND parent IN (SELECT id FROM u))")
# Rare terms through the stored index, frequent ones by a scan; which of the two a term gets shows in the last column.
_TERMS = ("order-1", "order-77", "nation_1", "CUSTOMER#00000001", 'regex:"order-(12|21)[0-9]\\.|nation_9"', "path:asia")


def _index_or_scan(spark: SparkSession, folder: str) -> DataFrame:
    store, scanning, out = SnapshotStore(spark, f"{scratch.folder(spark)}/stores/{uuid.uuid4().hex}", rows_per_file=500, indexed=True), [], None
    m = store.save(files(spark, folder), "f", 1)
    for request in map(Request, _TERMS):
        names = store.named(m, request.plan.tree, request.options)
        if names is None:  # those that scan share one scan
            scanning.append(request)
            continue
        some = matches_of(store.rows_of(m, names), [request]).select("term", "id", F.lit(False).alias("scanned"))
        out = some if out is None else out.unionByName(some)
    if scanning:
        some = matches_of(store.rows_of(m, None), scanning).select("term", "id", F.lit(True).alias("scanned"))
        out = some if out is None else out.unionByName(some)
    return out


_TERM_SQL = ("contains(name_fold, 'order-1')", "contains(name_fold, 'order-77')", "contains(name_fold, 'nation_1')", "contains(name_fold, 'customer#00000001')", "regexp_matches(name, '(?i)order-(12|21)[0-9]\\.|nation_9')", "contains(path_fold, 'asia')")
# A term is scanned for if the rarest run of three characters of each text it needs, added up over alternatives, is in over 2 % of the names.
_RAREST = lambda t: f"least({', '.join(f'count_if(contains(name_fold, {t[k : k + 3]!r}))' for k in range(len(t) - 2))})"
_BOUND_SQL = (*map(_RAREST, ("order-1", "order-77", "nation_1", "customer#00000001")), f"{_RAREST('order-12')} + {_RAREST('order-21')} + least({_RAREST('nat')}, {_RAREST('on_9')})", None)  # names can't tell of paths
_SCANNED_SQL = tuple("true" if b is None else f"(SELECT {b} > 0.02::DOUBLE * count(*) FROM files)" for b in _BOUND_SQL)
register("index_or_scan", _index_or_scan, f"{FILES} " + " UNION ALL ".join(f"SELECT '{t.replace(chr(39), chr(39) * 2)}' AS term, id, {s} AS scanned FROM files WHERE {w}" for t, s, w in zip(_TERMS, _SCANNED_SQL, _TERM_SQL, strict=True)))


# Reconciling: the listing lacks, changes and adds some orders.
def _listed(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder).filter("depth = 4")
    kept = f.filter("id % 10 <> 1").select("parent", "name", (F.col("size") + F.when(F.col("id") % 10 == 2, 5).otherwise(0)).alias("size"), "mtime", (F.col("id") % 10 == 4).alias("is_dir"))
    return kept.union(f.filter("id % 10 = 3").select("parent", F.concat("name", F.lit(".new")), "size", "mtime", F.lit(False)))


_OLD = "old AS (SELECT id, parent, name, size, mtime, is_dir FROM files WHERE depth = 4)"
_NEW = """new AS (SELECT parent, name, size + CASE WHEN id % 10 = 2 THEN 5 ELSE 0 END AS size, mtime, id % 10 = 4 AS is_dir FROM files WHERE depth = 4 AND id % 10 <> 1
  UNION ALL SELECT parent, name || '.new', size, mtime, false FROM files WHERE depth = 4 AND id % 10 = 3)"""
register("reconcile_diff", lambda s, d: reconcile.diff_in(files(s, d).filter("depth = 4"), _listed(s, d)), f"""{FILES}, {_OLD}, {_NEW}
SELECT coalesce(o.parent, n.parent) AS parent, coalesce(o.name, n.name) AS name, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.name IS NULL THEN 'delete'
  WHEN o.is_dir <> n.is_dir THEN 'replace' WHEN o.size <> n.size OR o.mtime <> n.mtime THEN 'update' ELSE 'same' END AS action,
  o.id, coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.is_dir, o.is_dir) AS is_dir
FROM old o FULL JOIN new n ON o.parent = n.parent AND o.name = n.name""")
register("stale_children", lambda s, d: reconcile.stale(files(s, d).filter("depth = 4"), _listed(s, d)).select("id", "path"), f"{FILES}, {_NEW} SELECT id, path FROM files WHERE depth = 4 AND (parent, name) NOT IN (SELECT (parent, name) FROM new)")


def _reconciled(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder)
    return reconcile.apply(f, reconcile.diff_in(f.filter("depth = 4"), _listed(spark, folder)), 1 << 40).select("path", "size", "mtime", "is_dir")


register("reconcile_apply", _reconciled, f"""{FILES}, {_NEW} SELECT path, size, mtime, is_dir FROM files WHERE depth < 4
UNION ALL SELECT f.path || '/' || n.name, n.size, n.mtime, n.is_dir FROM new n JOIN files f ON n.parent = f.id""")
# Folders of which nothing is listed any more lose their children; others aren't looked at.
register("reconcile_emptied", lambda s, d: reconcile.diff(files(s, d), _listed(s, d).filter("parent % 3 = 0"), files(s, d).filter("depth = 3 and id % 3 <> 2").select(F.col("id").alias("parent"))), f"""{FILES}, old AS (SELECT * FROM files WHERE depth = 4 AND parent % 3 <> 2), {_NEW},
listed AS (SELECT * FROM new WHERE parent % 3 = 0)
SELECT coalesce(o.parent, n.parent) AS parent, coalesce(o.name, n.name) AS name, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.name IS NULL THEN 'delete'
  WHEN o.is_dir <> n.is_dir THEN 'replace' WHEN o.size <> n.size OR o.mtime <> n.mtime THEN 'update' ELSE 'same' END AS action,
  o.id, coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.is_dir, o.is_dir) AS is_dir
FROM old o FULL JOIN listed n ON o.parent = n.parent AND o.name = n.name""")
register("metadata_refresh", lambda s, d: reconcile.refresh(files(s, d), files(s, d).filter("id % 4 = 0").select("path", (F.col("size") + 3).alias("size"), (F.col("mtime") + 60).alias("mtime"), (F.col("id") % 8 == 0).alias("is_dir"))).select("id", "size", "mtime"),
f"""{FILES}, now AS (SELECT *, id % 4 = 0 AND is_dir = (id % 8 = 0) AS seen FROM files) SELECT id, size + CASE WHEN seen THEN 3 ELSE 0 END AS size, mtime + CASE WHEN seen THEN 60 ELSE 0 END AS mtime FROM now""")
register("deny_subtree", lambda s, d: reconcile.deny(files(s, d), s.createDataFrame([("/ASIA",), ("/EUROPE",)], "path string")).select("id"), f"{FILES} SELECT id FROM files WHERE NOT (path IN ('/ASIA', '/EUROPE') OR starts_with(path, '/ASIA/') OR starts_with(path, '/EUROPE/'))")
# Rules, scopes and mounts.
_MOUNTS = [("/", True), ("/ASIA", False), ("/EUROPE", False), ("/EUROPE/NATION_3", True)]
register("mount_longest_prefix", lambda s, d: rules.inspectable(files(s, d).select("path"), s.createDataFrame(_MOUNTS, "mount string, is_local boolean")), f"""{FILES},
m AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {str(x).lower()})" for m, x in _MOUNTS)}) v(mount, is_local))
SELECT path, max_by(is_local, length(mount)) AS local FROM files JOIN m ON mount = '/' OR path = mount OR starts_with(path, mount || '/') GROUP BY path""")


def _project_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as entries of customer folders, some of them markers and build folders."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    k = F.col("o_orderkey")
    name = F.when(k % 9 == 0, "package.json").when(k % 5 == 0, "build").when(k % 7 == 0, "node_modules").when(k % 11 == 0, "kept.TMP").otherwise(F.concat(F.lit("f"), k.cast("string")))
    path = F.concat(F.lit("/c"), F.col("o_custkey").cast("string"), F.lit("/"), name)
    return o.select(k.cast("long").alias("id"), F.col("o_custkey").alias("parent"), name.alias("name"), path.alias("path"), F.lit(False).alias("hidden"), (k % 5 == 0).alias("is_dir"))


_RULES = rules.ExcludeRules(file_patterns=("*.tmp",))
_ENTRIES = """WITH e AS (SELECT o_orderkey AS id, o_custkey AS parent, CASE WHEN o_orderkey % 9 = 0 THEN 'package.json' WHEN o_orderkey % 5 = 0 THEN 'build' WHEN o_orderkey % 7 = 0 THEN 'node_modules'
  WHEN o_orderkey % 11 = 0 THEN 'kept.TMP' ELSE 'f' || o_orderkey END AS name, o_orderkey % 5 = 0 AS is_dir FROM orders),
m AS (SELECT *, max(name = 'package.json') OVER (PARTITION BY parent) AS project FROM e)"""
register("project_marker_window", lambda s, d: rules.in_project(_project_entries(s, d)).select("id", "in_project"), f"{_ENTRIES} SELECT id, project AS in_project FROM m")
register("project_marker_exclude", lambda s, d: rules.apply_rules(_project_entries(s, d), _RULES).select("id", "name"), f"""{_ENTRIES},
x AS (SELECT *, '/c' || parent || '/' || name AS path, name = 'node_modules' OR (project AND name = 'build') OR (NOT is_dir AND lower(name) LIKE '%.tmp') AS gone FROM m)
SELECT id, name FROM x WHERE NOT gone AND path NOT IN (SELECT path FROM x WHERE gone AND is_dir)""")
register("nested_root_elim", lambda s, d: rules.outermost_rows(files(s, d).filter("id % 3 = 1").select("path")), f"{FILES}, r2 AS (SELECT DISTINCT path FROM files WHERE id % 3 = 1) SELECT path FROM r2 a WHERE NOT EXISTS (SELECT 1 FROM r2 b WHERE starts_with(a.path, b.path || '/'))")
# The same over whole levels: paths unnested to what is above them, and an anti-join by equality.
register("nested_root_elim_whole", lambda s, d: rules.outermost_rows(files(s, d).filter("depth >= 3").select("path")), f"""{FILES}, r3 AS (SELECT DISTINCT path FROM files WHERE depth >= 3),
above AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS up FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM r3))
SELECT path FROM r3 WHERE path NOT IN (SELECT a.path FROM above a JOIN r3 b ON a.up = b.path)""")
_SYSTEM = ("/System/Volumes/VM", "/System/Volumes/Data", "/System/Volumes/VMX", "/net/share", "/home")
register("effective_rules", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("name"), F.concat(F.element_at(F.array(*map(F.lit, _SYSTEM)), (F.col("event_id") % 5 + 1).cast("int")), F.lit("/"), "event_type").alias("path"), F.lit(False).alias("hidden"))
  .filter(~rules.effective(rules.ExcludeRules(), [("/net/share", False), ("/home", True)]).entry_column(F.lit(False))).select("event_id", "path"), "SELECT event_id, CASE event_id % 5 WHEN 2 THEN '/System/Volumes/VMX/' ELSE '/home/' END || event_type AS path FROM events WHERE event_id % 5 IN (2, 4)")
register("canonical_paths", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", canonical_column(F.concat(F.element_at(F.array(*map(F.lit, ("/var", "/tmp", "/etcetera", "/System/Volumes/Data/x"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit("/"), "event_type")).alias("path")), "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/private/var/' WHEN 1 THEN '/private/tmp/' WHEN 2 THEN '/etcetera/' ELSE '/x/' END || event_type AS path FROM events")


# The change feed: events stand for changes of their users' folders.
def _feed(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    t = F.col("event_type")
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), t)
    off = F.lit(False)
    return e.select("event_id", path.alias("path"), (t == "error").alias("must_scan"), t.isin("signup", "purchase").alias("structural"), t.isin("purchase", "view").alias("metadata"), off.alias("mount"), off.alias("dropped"))


_ROUTED = """WITH e AS (SELECT event_id, '/u/' || user_id AS dir, event_type AS t FROM events), routed AS (
  SELECT event_id, dir || '/error' AS path, 'list' AS task, true AS deep FROM e WHERE t = 'error'
  UNION ALL SELECT event_id, dir, 'list', false FROM e WHERE t IN ('signup', 'purchase')
  UNION ALL SELECT event_id, dir || '/' || t, 'refresh', false FROM e WHERE t IN ('purchase', 'view')
  UNION ALL SELECT event_id, dir || '/' || t, 'list', false FROM e WHERE t NOT IN ('error', 'signup', 'purchase', 'view'))"""
register("change_routing", lambda s, d: changes.route(_feed(s, d), ["/u"]), f"{_ROUTED} SELECT event_id, path, task, deep FROM routed")
register("change_coalescing", lambda s, d: changes.coalesced(changes.route(_feed(s, d), ["/u"])), f"{_ROUTED} SELECT path, task, bool_or(deep) AS deep FROM routed GROUP BY path, task")
# Events that ask for a whole new scan: lost history anywhere, mounts and subtree events at a volume's root within the roots.
def _whole(spark: SparkSession, folder: str) -> DataFrame:
    e, t, k = spark.read.parquet(f"{folder}/events.parquet"), F.col("event_type"), F.col("event_id") % 3
    path = F.concat(F.when(k == 0, "/Volumes/v").when(k == 1, "/u/").otherwise("/x/"), F.col("user_id").cast("string"))
    return e.select("event_id", path.alias("path"), (t == "error").alias("must_scan"), (t == "signup").alias("structural"), (t == "view").alias("metadata"), (t == "purchase").alias("mount"), (t == "click").alias("dropped"))


register("change_rebuilds", lambda s, d: changes.route(_whole(s, d), ["/u", "/Volumes"]).filter("task = 'rebuild'").select("event_id", "path"), "SELECT event_id, '/' AS path FROM events WHERE event_type = 'click' OR (event_type = 'purchase' AND event_id % 3 < 2) OR (event_type = 'error' AND event_id % 3 = 0)")
register("flag_bits", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in changes.classify((F.col("event_id") * 37).cast("int")).items()]), "SELECT event_id, (event_id * 37) & 1 <> 0 AS must_scan, (event_id * 37) & 14 <> 0 AS dropped, (event_id * 37) & 224 <> 0 AS mount, (event_id * 37) & 2816 <> 0 AS structural, (event_id * 37) & 62464 <> 0 AS metadata FROM events")
register("checkpoint_max", lambda s, d: changes.cursor_row(_feed(s, d), -1).select("last_event"), "SELECT max(event_id) AS last_event FROM events")
# The events as a log of files, read back behind an event id.
def _logged(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{scratch.folder(spark)}/logs/{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{folder}/events.parquet")
    changelog.write(e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").cast("long").alias("event_id"), (F.col("event_id") * 37 % 65536).cast("int").alias("flags")), place)
    return changes.decoded(changelog.read(spark, place, 99)).select("path", "event_id", "structural", "metadata")


register("changelog_batch", _logged, "SELECT '/u/' || user_id AS path, event_id::BIGINT AS event_id, (event_id * 37) & 2816 <> 0 AS structural, (event_id * 37) & 62464 <> 0 AS metadata FROM events WHERE event_id > 99")
register("retry_delays", lambda s, d: changes.retries(_feed(s, d).select("path", (F.col("event_id") % 9).cast("int").alias("attempt"))), "SELECT '/u/' || user_id || '/' || event_type AS path, (event_id % 9 + 1)::INT AS attempt, least(60, 1 << least(event_id % 9, 6))::INT AS delay FROM events")
# The optional index.
register("trigram_postings", lambda s, d: index.selectivity(index.postings(files(s, d))), f"{FILES}, g AS (SELECT DISTINCT id, substr(name_fold, i, 3) AS trigram FROM (SELECT id, name_fold, unnest(range(1, length(name_fold) - 1)) AS i FROM files)) SELECT trigram, count(*) AS n FROM g GROUP BY trigram")
register("trigram_lookup", lambda s, d: index.lookup(files(s, d), index.postings(files(s, d)), "Order-12").select("id"), f"{FILES} SELECT id FROM files WHERE contains(name_fold, 'order-12')")
register("trigram_statistics", lambda s, d: index.statistics(index.postings(files(s, d))), f"{FILES}, g AS (SELECT DISTINCT id, substr(name_fold, i, 3) AS trigram FROM (SELECT id, name_fold, unnest(range(1, length(name_fold) - 1)) AS i FROM files)) SELECT count(DISTINCT id) AS indexed_records, count(*) AS postings, count(DISTINCT trigram) AS trigrams FROM g")
register("trigram_bytes", lambda s, d: index.index_bytes(index.postings(files(s, d))), f"{FILES}, g AS (SELECT DISTINCT id, substr(name_fold, i, 3) AS trigram FROM (SELECT id, name_fold, unnest(range(1, length(name_fold) - 1)) AS i FROM files)) SELECT 11 * count(*) AS bytes FROM g")

__all__ = ["QUERIES", "SQL", "files", "order", "quote", "trigrams"]
