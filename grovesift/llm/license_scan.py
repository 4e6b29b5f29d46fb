r"""License scans by diagonal voting.

Native: DataFrame functions only. Every run of ``K`` words of every document is joined by its hash (and
verified by its words) to the places where the templates hold the same run. A match at word ``p`` of the
document and place ``q`` of the template votes for the diagonal ``p - q``, if it stands in order: another match of the template is within ``GAP + 1``
words of it, before or behind in both, on a diagonal at most ``GAP`` away. So the parts of a notice in another order have no
votes, and a span is at most ``GAP + 1`` times as long as what it covers of the template. Neighbouring diagonals, at most
``GAP`` words apart, are merged, so that a few inserted or lost words leave one placement; a placement is
accepted when it covers ``COVER`` per cent of the template's runs, or all of them in a template of fewer than
``LONG`` runs, where a single word tells licenses apart.

The templates are a fixed list, so their broadcast has a fixed size. One pass reads and splits each text
once; a row for each document goes along with the matches, and nothing but matches and these rows is shuffled.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.

Defined results: a null or empty text has no words and no labels, and score 0; repeated rows and null ids
each keep their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, GAP, COVER, LONG = 2, 2, 80, 10

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences of public license texts and notices, and the labels that they add.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. The two characters whose lower case is or begins with an ASCII letter are put aside first."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00aa")), F.lit("\u0130"), F.lit("\u00aa"))
    return F.array_remove(F.split(F.lower(plain), NOT_WORD), "")


def grams(array: Column, k: int) -> Column:
    """Runs of ``k`` words, joined by blanks; null where a run would pass the end."""
    out = array
    for j in range(1, k):
        ahead = F.slice(array, F.lit(j + 1), F.greatest(F.size(array) - j, F.lit(0)))
        out = F.zip_with(out, ahead, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def places(spark, templates, k: int = K) -> DataFrame:
    """(h, gram, t, q, size): every run of every template; t is the template's number, size its count of runs."""
    rows = [(" ".join(w[q : q + k]), t, q, len(w) - k + 1) for t, (text, _) in enumerate(templates) for w in [text.split()] for q in range(len(w) - k + 1)]
    local = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("t_gram", "t", "q", "size"), strict=True)]) for r in rows])))
    return local.withColumn("t_h", F.xxhash64("t_gram"))


def placements(docs: DataFrame, templates, k: int = K, gap: int = GAP, whole: int = 0) -> DataFrame:
    """(uid, doc_id, n_words, t, start, first, last, runs, size): merged diagonals; t is null in one row of each document at least.

    ``first`` and ``last`` are the document's first and last word of a placement. The first ``whole`` templates stand only
    as they are, so that their matches need no neighbours.
    """
    split = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words(F.col("text")).alias("w"))
    rolled = split.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams(F.col("w"), k)).alias("p", "gram"))
    at = F.broadcast(places(docs.sparkSession, templates, k))
    met = rolled.withColumn("h", F.xxhash64("gram")).join(at, (F.col("h") == F.col("t_h")) & (F.col("gram") == F.col("t_gram")), "left")
    met = met.filter(F.col("t").isNotNull() | F.coalesce(F.col("p") == 0, F.lit(True)))
    by_place = Window.partitionBy("uid", "t").orderBy("p")
    before, behind = (F.collect_list("at").over(by_place.rangeBetween(*r)) for r in ((-1 - gap, -1), (1, 1 + gap)))

    def follows(x: Column, y: Column) -> Column:
        return (y["q"] > x["q"]) & (y["q"] - x["q"] <= gap + 1) & (F.abs((y["p"] - y["q"]) - (x["p"] - x["q"])) <= gap)

    placed = met.select("uid", "doc_id", "n_words", "p", "t", "q", "size", F.struct("p", "q").alias("at")).withColumns({"before": before, "behind": behind})
    ordered = F.exists("before", lambda x: follows(x, F.col("at"))) | F.exists("behind", lambda x: follows(F.col("at"), x))
    lone = F.col("t").isNull() | (F.col("t") < whole) | (F.col("size") == 1)
    # A document whose matches all go keeps a row, as one without matches does.
    in_order = placed.withColumn("ordered", lone | ordered)
    in_order = in_order.filter(F.col("ordered") | (F.col("p") == 0)).withColumns({c: F.when(F.col("ordered"), F.col(c)) for c in ("t", "q", "size")})
    votes = in_order.groupBy("uid", "doc_id", "n_words", "t", "size", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("low"), F.max("p").alias("high"))
    near = Window.partitionBy("uid", "t").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > gap, F.lit(False)).cast("int")
    merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(near))
    return merged.groupBy("uid", "doc_id", "n_words", "t", "size", "run").agg(
        F.min("diagonal").alias("start"), F.min("low").alias("first"), (F.max("high") + (k - 1)).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("runs"),
        F.transform(F.filter(F.collect_list(F.struct("diagonal", F.size("qs").alias("n"))), lambda x: x["n"] == F.first("size")), lambda x: x["diagonal"]).alias("whole"),
    )


def spans(docs: DataFrame, templates=TEMPLATES, cover: int = COVER) -> DataFrame:
    """(doc_id, label, first, last, share): where accepted templates stand, from the first to the last word."""
    found = placements(docs, tuple(templates))
    need = F.when(F.col("size") < LONG, 100).otherwise(cover)
    label = F.get(F.array(*[F.lit(name) for _, name in templates]), F.col("t"))
    return found.filter(F.col("runs") * 100 >= F.col("size") * need).select("doc_id", label.alias("label"), "first", "last", (F.col("runs") / F.col("size")).alias("share"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, cover: int = COVER) -> DataFrame:
    """One row for each document: where the phrases stand, and the labels of phrases and accepted templates.

    ``score`` is the largest share of a phrase's or template's runs that one placement covers.
    """
    both = tuple(phrases) + tuple(templates)
    label = F.get(F.array(*[F.lit(name) for _, name in both]), F.col("t"))
    found = placements(docs, both, whole=len(phrases))
    base = F.when(F.col("t") < len(phrases), F.col("whole"))
    need = F.when(F.col("size") < LONG, 100).otherwise(cover)
    won = (F.col("t") >= len(phrases)) & (F.col("runs") * 100 >= F.col("size") * need)
    each = found.select(
        "uid", "doc_id", "n_words", F.coalesce(F.size(base), F.lit(0)).alias("n"), F.array_min(base).alias("low"), F.array_max(base).alias("high"),
        F.when(F.size(base) > 0, label).alias("base_label"), F.when(won, label).alias("label"), (F.col("runs") / F.col("size")).alias("share"),
    )
    summed = each.groupBy("uid", "doc_id", "n_words").agg(
        F.sum("n").cast("long").alias("n_base"), F.min("low").cast("long").alias("first_word"), F.max("high").cast("long").alias("last_word"),
        F.collect_set("base_label").alias("b"), F.collect_set("label").alias("m"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return summed.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("b"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("b", "m")), ",").alias("labels"), "score",
    )


def _values(templates) -> str:
    return ", ".join(f"({t}, '{text}', '{label}')" for t, (text, label) in enumerate(templates))


ORACLE = f"""
WITH templates(t, phrase, label) AS (VALUES {_values(PHRASES + TEMPLATES)}),
parts AS (SELECT t, label, string_split(phrase, ' ') AS w FROM templates),
places AS (SELECT t, label, len(w) - 1 AS size, unnest(range(0, len(w) - 1)) AS q, w FROM parts),
runs AS (SELECT t, label, size, q, w[q + 1] || ' ' || w[q + 2] AS gram FROM places),
docs AS (SELECT row_number() OVER () AS uid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
spots AS (SELECT uid, unnest(range(0, greatest(len(w) - 1, 0))) AS p, w FROM docs),
every AS MATERIALIZED (SELECT uid, p, q, p - q AS diagonal, t, size, label FROM (SELECT uid, p, w[p + 1] || ' ' || w[p + 2] AS gram FROM spots) JOIN runs USING (gram)),
met AS (SELECT uid, diagonal, q, t, size, label FROM every m WHERE t < {len(PHRASES)} OR size = 1 OR EXISTS (SELECT 1 FROM every x WHERE x.uid = m.uid AND x.t = m.t
  AND abs(x.p - m.p) BETWEEN 1 AND {GAP + 1} AND abs(x.q - m.q) BETWEEN 1 AND {GAP + 1} AND (x.p > m.p) = (x.q > m.q) AND abs(x.diagonal - m.diagonal) <= {GAP})),
votes AS (SELECT uid, t, size, label, diagonal, count(*) AS n FROM met GROUP BY ALL),
marked AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY uid, t ORDER BY diagonal) > {GAP}, false)::INT AS fresh FROM votes),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY uid, t ORDER BY diagonal) AS run FROM marked),
covered AS (SELECT uid, t, size, label, run, count(DISTINCT q) AS runs FROM numbered JOIN met USING (uid, t, size, label, diagonal) GROUP BY ALL),
base AS (SELECT uid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM votes WHERE t < {len(PHRASES)} AND n = size GROUP BY uid),
named AS (SELECT uid, label FROM votes WHERE t < {len(PHRASES)} AND n = size
  UNION SELECT uid, label FROM covered WHERE t >= {len(PHRASES)} AND runs * 100 >= size * CASE WHEN size < {LONG} THEN 100 ELSE {COVER} END),
joined AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY uid),
best AS (SELECT uid, max(runs / size) AS score FROM covered GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(joined.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (uid) LEFT JOIN joined USING (uid) LEFT JOIN best USING (uid)
"""
