"""The corpus pipeline: documents in, token ids of the clean, distinct ones out.

Each stage gets what the stage before it kept. Stages 1 to 4 return the columns of ``documents``; the last one
returns doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back.

Defined results: only doc_id and text are needed, and all other columns pass through; of lang and source, the last stage
gives those that there are. Without labelled rows no language is learned, and nothing is rejected; otherwise null texts
and those without letters are. Documents without an id stay in ``near_dedup``, rows that share an id and aren't
similar too, repeated rows become one. Null texts hold no items and no secrets, and have no ids. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovesift.llm import bpe, decontam, langid, neardup, secrets
from grovesift.llm.common import materialize, small_batches, table, tokenizer_path
from grovesift.scratch import drop


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; fills missing languages in."""
    small_batches(spark)
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(docs)
    if not model.langs:
        return docs
    named = docs.withColumn("_grovesift_p", langid.prediction(F.col("text"), model)).filter(~F.col("_grovesift_p")["rejected"])
    return named.withColumn("lang", F.coalesce("lang", F.col("_grovesift_p")["lang_pred"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id, once. Documents without an id stay.

    Rows that share an id and aren't similar are different documents; of those without words, one stays if its id has
    no other row. For this, rows of a table with repeated ids are numbered in the order of their ids.
    """
    small_batches(spark)
    named, n, bare = docs.filter(F.col("doc_id").isNotNull()), "_grovesift_n", "_grovesift_bare"
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = named.withColumn(n, F.col("doc_id"))
        kept = neardup.groups(rows.select("doc_id", "text")).filter("kept").select("doc_id")
    else:
        wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        order = ["doc_id", bare, F.xxhash64("text")]
        sorted_ = named.withColumn(bare, wordless).repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
        rows = materialize(sorted_.withColumn(n, F.monotonically_increasing_id()), "numbered")
        kept = neardup.groups(rows.filter(~F.col(bare)).select(F.col(n).alias("doc_id"), "text")).filter("kept").select("doc_id")
        alone = rows.groupBy("doc_id").agg(F.min_by(bare, n).alias(bare), F.min(n).alias(n)).filter(bare).select(n)
        kept = kept.union(alone)
    kept = materialize(kept.select(F.col("doc_id").alias("_grovesift_id")).distinct(), "kept")
    # A merge join at every size: a broadcast of small lists of ids alone would make the stage look cheaper than it is at scale.
    return rows.join(kept.hint("merge"), rows[n] == kept["_grovesift_id"], "left_semi").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or an edited copy of one."""
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets within texts; all documents stay."""
    small_batches(spark)
    hidden = secrets.redact(docs, secrets.fit(docs))
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    small_batches(spark)
    path, named = tokenizer_path(), [c for c in ("lang", "source") if c in docs.columns]
    ids = docs.select("doc_id", *named, "text", bpe.encode(F.col("text"), path).alias("ids"))
    back = ids.withColumn("round_trip", bpe.decode(F.col("ids"), path) == F.coalesce("text", F.lit("")))
    return back.select("doc_id", *named, F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", hide_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
