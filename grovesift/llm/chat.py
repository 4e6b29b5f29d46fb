"""Chat formatting: conversations rebuilt from event logs, then rendered with a reversible template.

Native: DataFrame functions only. Events are dealt by conversation once; sorting, folding and rendering keep
that partitioning.

Defined results: a null text or role is an empty string, a null ``kind`` a ``message``; repeated rows are
repeated events; ties in ``seq`` are ordered by kind, role and text, and among messages by message id; an
empty log gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the template reserves, each with what stands for it inside texts. The first must stay first.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, at, role, text) of a log (conv_id, msg, seq, kind, role, text).

    ``message`` and ``edit`` set the text of a message, ``regenerate`` throws away what has come so far (and
    sets what it carries itself), ``delta`` appends. ``at`` is the first sequence number of the message, its
    role the first one that isn't null.
    """
    e = events.select(
        "conv_id", "msg", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).repartition("conv_id")
    folded = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    # Where the last event stands that isn't a delta; what comes before it has no effect on the text.
    reset = F.greatest(F.lit(1), F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i + 1))))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id", "msg", F.col("log")[0]["seq"].alias("at"),
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("log", reset, F.size("log")), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and the spans of it that are learned from.

    ``loss`` has a struct (start, len) for every message of the role ``learn``, in code points of ``formatted``,
    around the escaped text alone.
    """
    in_order = Window.partitionBy("conv_id").orderBy("at", "msg")
    parts = messages.select("conv_id", "at", "msg", "role", (F.concat(F.lit(OPEN), escape("role"), F.lit(SHUT))).alias("head"), escape("text").alias("body"))
    placed = parts.withColumn("upto", F.sum(F.length("head") + F.length("body") + len(END)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("upto") - len(END) - F.length("body")).cast("long").alias("start"), F.length("body").cast("long").alias("len"))
    turns = placed.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("at", "msg", F.concat("head", "body", F.lit(END)).alias("text"), F.when(F.col("role") == learn, span).alias("span")))
        ).alias("turns")
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.split(formatted, r"<\|end\|>\n")
    body = F.slice(turns, 1, F.size(turns) - 1)  # after the last mark stands nothing
    return F.transform(
        body,
        lambda t: F.struct(
            unescape(F.substring_index(F.substring(t, len(OPEN) + 1, 1 << 30), SHUT, 1)).alias("role"),
            unescape(F.substr(t, F.locate(SHUT, t) + len(SHUT))).alias("text"),
        ),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """Formats a plain table (conv_id, turn, role, text): each row is one ``message`` event, in the order of turns.

    Rows that share a turn stay separate messages, in the order of role and text.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    events = plain.repartition("conv_id").select(
        "conv_id", F.struct("turn", F.row_number().over(same).alias("copy")).alias("msg"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )
    return render(fold_events(events))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")
    read = formatted.select("conv_id", read_back(F.col("formatted")).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts consist of another template's control strings."""
    kinds = dict(conversations.dtypes)
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


_SQL_ESCAPED = "replace(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3')"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_SQL_ESCAPED.format('role')}) + length({_SQL_ESCAPED.format('text')}) + {len(OPEN + SHUT + END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
