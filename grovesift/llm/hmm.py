r"""Language-model scoring with a hidden Markov model over word classes.

Tokens are the words ``[^\x20\x09-\x0D]+`` of a text with A-Z lower-cased, then one end mark. The ``OWN`` most
frequent tokens are classes of their own; all others fall into ``SHARED`` classes by their hash. Every task sends its
expected counts of all classes, so their number is fixed: what is sent grows with the corpus, not with its square. A latent state
emits a class, and a class emits a token with the probability (c + 0.1) / (N + 0.1 (V + 1)) over the counts of
the training corpus within the class; a class of its own emits its token with certainty. So every token, seen
or not, has a probability, and those of a class add up to one.

Training: token counts over the whole training corpus; first states from a bounded sample; then rounds of
Baum-Welch over the whole training corpus, whose expected counts are added up across partitions, until the
log-likelihood of a token gains less than ``SETTLED`` of itself, ``ROUNDS`` at most.
For training, texts are cut into runs of ``RUN`` tokens, so that many go through the recursion side by side.
Scoring runs the scaled forward recursion over each whole text.

Counts live in a written table. Those of the most frequent tokens, ``KNOWN`` at most, go to every worker; the others are
joined to the documents' rare tokens. Which way a count takes doesn't change a score.

Defined results: a null or empty text is the end mark alone; repeated rows are counted and scored each; rows of
a null id are learned from; without training rows the score is that of one uniform class; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, bounded_sample, fold, materialize, words_of

STATES, OWN, SHARED, KNOWN = 8, 4096, 1024, 131_072
RUN, SAMPLE_ROWS, SAMPLE_ROUNDS = 128, 1200, 12
ROUNDS, SETTLED = 4, 0.002
ADD = 0.1
END = np.uint64(0xE9D0F1A52C3B4D67)
#: Bytes of text that are hashed, or scored side by side, at once.
BLOCK = 1 << 22


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, the end marks included, and where each text's begin (one more than texts)."""
    words, a, b = words_of(texts)
    n = len(texts)
    begin = np.concatenate([a + np.arange(n), [len(words) + n]])
    out = np.full(len(words) + n, END, np.uint64)
    mark = np.zeros(len(out), bool)
    mark[begin[1:] - 1] = True
    out[~mark] = words
    return out, begin


@dataclass
class Lexicon:
    """Counts of the most frequent tokens, and of the classes."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    own: np.ndarray  # for each: its own class, or -1
    total: int  # N
    distinct: int  # V
    shared_log_z: np.ndarray  # log10(N + 0.1 (V + 1)) of each shared class
    prior: np.ndarray  # share of each class among the training tokens

    @property
    def log_total(self) -> float:
        return float(np.log10(self.total + ADD * (self.distinct + 1)))

    @property
    def owned(self) -> int:
        """How many classes are kept for single tokens; the shared ones follow."""
        return len(self.prior) - len(self.shared_log_z)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, -1)

    def classes(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.own[at], -1) if len(self.own) else np.full(len(h), -1)
        return np.where(own >= 0, own, self.owned + (h >> np.uint64(40)).astype(np.int64) % len(self.shared_log_z))

    def log_z(self, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """What log10(c + 0.1) of a token is reduced by to be its probability within its class."""
        out = self.shared_log_z[np.maximum(classes - self.owned, 0)]
        own = classes < self.owned
        out[own] = np.log10(self.counts[at[own]] + ADD)
        return out


@dataclass
class Model:
    start: np.ndarray  # state of a text's first token
    inner: np.ndarray  # state at the start of a training run within a text
    move: np.ndarray
    emit: np.ndarray  # class x state

    @staticmethod
    def first(prior: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), STATES))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        flat = np.full(STATES, 1 / STATES)
        return Model(flat, flat, move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def learned(self, counts: np.ndarray, prior: np.ndarray) -> Model:
        """The model of the expected counts (see ``expected``), smoothed by the class shares."""
        k = STATES
        start, inner = counts[:k] + 1, counts[k : 2 * k] + 1
        move = counts[2 * k : 2 * k + k * k].reshape(k, k) + 0.5
        emit = counts[2 * k + k * k :].reshape(-1, k) + 50 * prior[:, None]
        return Model(start / start.sum(), inner / inner.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, classes: np.ndarray, begin: np.ndarray, likelihood: list[float] | None = None) -> np.ndarray:
        """Baum-Welch: expected counts of first states, of run starts, of moves and of emissions, in one vector.

        ``likelihood`` gets the log10-likelihoods of parts of what was seen.
        """
        k = STATES
        out = np.zeros(2 * k + k * k + self.emit.size)
        moves = np.zeros((k, k))
        size = np.diff(begin)
        runs = -(-size // RUN)
        text = np.repeat(np.arange(len(size)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = begin[text] + number * RUN
        n = np.minimum(RUN, begin[text + 1] - at)
        order = np.argsort(-n, kind="stable")
        for some in np.array_split(order, max(1, len(order) // 4096)):
            a, m, inside = at[some], n[some], number[some] > 0
            steps = int(m.max(initial=0))
            live = [int((m > t).sum()) for t in range(steps)]
            alpha = []
            for t in range(steps):
                e = self.emit[classes[a[: live[t]] + t]]
                p = np.where(inside[:, None], self.inner, self.start) if t == 0 else alpha[-1][: live[t]] @ self.move
                p = p * e
                s = p.sum(1, keepdims=True)
                if likelihood is not None:
                    likelihood.append(float(np.log10(s).sum()))
                alpha.append(p / s)
            later, index, weight = None, [], []
            for t in range(steps - 1, -1, -1):
                seen = classes[a[: live[t]] + t]
                gamma = alpha[t].copy()
                if later is not None:
                    gamma[: len(later)] *= later
                    gamma /= gamma.sum(1, keepdims=True)
                index.append(seen)
                weight.append(gamma)
                if t:
                    back = self.emit[seen]
                    if later is not None:
                        back[: len(later)] *= later
                    before = alpha[t - 1][: live[t]]
                    back /= ((before @ self.move) * back).sum(1, keepdims=True)
                    moves += before.T @ back
                    later = back @ self.move.T
            seen, gamma = np.concatenate(index), np.concatenate(weight)
            first = gamma[len(gamma) - len(some) :]
            out[:k] += first[~inside].sum(0)
            out[k : 2 * k] += first[inside].sum(0)
            for s in range(k):
                out[2 * k + k * k + s :: k] += np.bincount(seen, gamma[:, s], len(self.emit))
        out[2 * k : 2 * k + k * k] += (moves * self.move).ravel()
        return out

    def forward(self, classes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each text's classes, by the scaled forward recursion over all of it."""
        size = np.diff(begin)
        order = np.argsort(-size, kind="stable")
        a, m = begin[order], size[order]
        total = np.zeros(len(size))
        p, live = np.tile(self.start, (len(size), 1)), len(size)
        held = np.ones(len(size))
        for t in range(int(m.max(initial=0))):
            while m[live - 1] <= t:
                live -= 1
            p = p[:live] if t == 0 else p[:live] @ self.move
            p = p * self.emit[classes[a[:live] + t]]
            s = p.sum(1)
            p /= s[:, None]
            held[:live] *= s
            if t % 16 == 15:  # a class has at least a share near 1e-9 in every state: 16 of them stay within a double
                total += np.log10(held)
                held[:] = 1
        out = np.zeros(len(size))
        out[order] = total + np.log10(held)
        return out


def _blocks(batches):
    """(columns but text, texts) of about ``BLOCK`` bytes; text is the last column."""
    for batch in batches:
        texts = binary(batch.column(batch.num_columns - 1))
        for first, end in blocks(texts, BLOCK):
            yield batch.slice(first, end - first), texts[first:end]


def count_tokens(training: DataFrame) -> DataFrame:
    """(h, c): every distinct token of the corpus and its count; counted by task first."""

    def count(batches):
        held, rows = [], 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h, kind="stable")
            h, c = h[order], np.concatenate([x[1] for x in held])[order]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[edge], np.add.reduceat(c, edge)

        for _, texts in _blocks(batches):
            held.append(np.unique(tokens(texts)[0], return_counts=True))
            rows += len(held[-1][0])
            if rows > 2_000_000:
                held = [merged()]
                rows = len(held[0][0])
                if rows > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1].astype(np.int64))], ["h", "c"])
                    held, rows = [], 0
        if held:
            h, c = merged()
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(c[i : i + 200_000].astype(np.int64))], ["h", "c"])

    return training.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame) -> Lexicon:
    """Reads the bounded parts of a table of counts: frequent tokens, those of classes of their own among them, and sums by class."""
    level = F.floor(F.log2("c") * 16)
    by_level = {r[0]: r for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    least, held = None, 0
    for k in sorted(by_level, reverse=True):
        held += by_level[k]["n"]
        if held > KNOWN:
            break
        least = k
    total, distinct = int(sum(r["c"] for r in by_level.values())), int(sum(r["n"] for r in by_level.values()))
    most = counts.orderBy(F.desc("c"), "h").limit(OWN)
    top = most if least is None else counts.filter(level >= least).union(most).distinct()
    top = top.toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    own = np.full(len(h), -1, np.int64)
    first = np.lexsort((h.view(np.int64), -c))[:OWN]
    own[first] = np.arange(len(first))
    n = np.zeros(SHARED)
    v = np.zeros(SHARED)
    kind = F.pmod(F.shiftrightunsigned("h", 40), F.lit(SHARED)).cast("int")
    for r in counts.groupBy(kind.alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["kind"]], v[r["kind"]] = r["n"], r["v"]
    np.subtract.at(n, (h[first] >> np.uint64(40)).astype(np.int64) % SHARED, c[first])
    np.subtract.at(v, (h[first] >> np.uint64(40)).astype(np.int64) % SHARED, 1)
    own_counts = np.zeros(OWN)
    own_counts[: len(first)] = c[first]
    share = np.concatenate([own_counts, n]) + ADD
    return Lexicon(h, c, own, total, distinct, np.log10(n + ADD * (v + 1)), share / share.sum())


def fit(training: DataFrame, counts: DataFrame, gains: list[float] | None = None) -> tuple[Lexicon, Model]:
    """The lexicon and the trained model; ``gains`` gets the log10-likelihood of a training token before each round over the corpus."""
    spark = training.sparkSession
    lex = lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)
    model = Model.first(lex.prior)

    def as_classes(batches):
        for _, texts in _blocks(batches):
            h, begin = tokens(texts)
            kinds = shared.value.classes(h, shared.value.find(h)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(kinds))], ["k"])

    sample = [np.asarray(r) for r in bounded_sample(training, SAMPLE_ROWS).select("text").mapInArrow(as_classes, "k array<int>").toPandas()["k"]]
    if not sample:
        return lex, model
    flat, begin = np.concatenate(sample), np.concatenate([[0], np.cumsum([len(x) for x in sample])])
    for _ in range(SAMPLE_ROUNDS):
        model = model.learned(model.expected(flat, begin), lex.prior)
    gains = [] if gains is None else gains
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def expect(batches, now=now):
            total, likelihood = None, []
            for _, texts in _blocks(batches):
                h, begin = tokens(texts)
                part = now.value.expected(shared.value.classes(h, shared.value.find(h)), begin, likelihood)
                total = part if total is None else total + part
            if total is not None:
                total = np.append(total, sum(likelihood))
                slot = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "v"])

        found = training.select("text").mapInArrow(expect, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
        expected = np.zeros(2 * STATES + STATES * STATES + model.emit.size + 1)
        expected[found["slot"].to_numpy()] = found["v"].to_numpy()
        model = model.learned(expected[:-1], lex.prior)
        gains.append(float(expected[-1]) / max(lex.total, 1))
        if len(gains) > 1 and gains[-1] - gains[-2] < SETTLED * abs(gains[-1]):
            break
    return lex, model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the documents whose fold modulo 10 isn't 0.
    """
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = docs.filter(~F.col("held_out"))
    counts = materialize(count_tokens(training), "counts")
    lex, model = fit(training, counts)
    spark = docs.sparkSession
    both = spark.sparkContext.broadcast((lex, model))

    def walk(batches):
        lex, model = both.value
        log_count = np.log10(lex.counts + ADD)
        for rows, texts in _blocks(batches):
            h, begin = tokens(texts)
            at = lex.find(h)
            kinds = lex.classes(h, at)
            known = at >= 0
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))
            by_text = lambda x, owner=owner, n=len(texts): np.bincount(owner, x, n)
            base = by_text(np.where(known, log_count[at] if len(log_count) else 0.0, 0.0))
            model_part = model.forward(kinds, begin) - by_text(lex.log_z(at, kinds))
            n = len(texts)
            uid = rows.column(0).to_numpy()
            # A row for each document, keyed by its number, and one for each rare token of each.
            pair = pd.DataFrame({"d": owner[~known], "h": h[~known].view(np.int64)}).value_counts(sort=False)
            d, rare = pair.index.get_level_values(0).to_numpy(), pair.index.get_level_values(1).to_numpy()
            m = len(pair)
            fill = lambda x, kind, m=m: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind), pa.nulls(m, kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid, uid[d]])), pa.array(np.concatenate([uid * 2 + 1, rare])), pa.array(np.concatenate([np.zeros(n, np.int64), pair.to_numpy()])),
                    fill(rows.column(1), pa.int64()), fill(rows.column(2), pa.bool_()), fill(np.diff(begin), pa.int64()),
                    fill(by_text(known).astype(np.int64), pa.int64()), fill(base, pa.float64()), fill(model_part, pa.float64()),
                ],
                ["uid", "h", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    walked = numbered.mapInArrow(walk, "uid long, h long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")
    c = F.when(F.col("n") > 0, F.col("c"))
    joined = walked.join(counts, "h", "left").withColumns(
        {"more": F.col("n") * F.log10(F.coalesce(c, F.lit(0)) + ADD), "seen": F.when(c > 0, F.col("n")).otherwise(0)}
    )
    one = joined.groupBy("uid").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base", "model")), F.sum("more").alias("more"), F.sum("seen").alias("seen")
    )
    mass = F.col("base") + F.col("more")
    return one.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (mass - F.col("n_tokens") * F.lit(lex.log_total)).alias("base_score"), (mass + F.col("model")).alias("score"),
    )


def base_scores(docs: DataFrame) -> DataFrame:
    """What :func:`score` says of single tokens; base_score is rounded."""
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


ORACLE_BASE = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, text, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 10 = 0 AS held_out FROM documents),
tokens AS MATERIALIZED (
  SELECT uid, held_out, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM docs
  UNION ALL SELECT uid, held_out, NULL FROM docs),
counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts),
each AS (SELECT uid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score
  FROM tokens t LEFT JOIN counts ON t.w IS NOT DISTINCT FROM counts.w, total GROUP BY uid)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, (SELECT n FROM total) AS train_tokens, round(base_score, 3) AS base_score
FROM docs JOIN each USING (uid)
"""
