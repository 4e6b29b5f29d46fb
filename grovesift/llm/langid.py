"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2 to 4 letters within a word, where the white space (or any other non-letter) on either
side counts as a letter. Each is hashed to one of ``BUCKETS`` embeddings; the mean of a text's embeddings goes
through a linear softmax. Embeddings and softmax are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. A part of the sample that isn't learned from sets the temperature, and the
score under which a prediction is rejected.

For prediction the two linear maps are one table of ``BUCKETS`` rows and a column for each language, and every
text is scored whole.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; so is every text when
there are no labelled rows; repeated rows and null ids keep their rows; columns of the input stay, but for those
called like the results, which these replace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, fold

BITS, DIM = 13, 16
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 2400
#: A prediction is rejected below this score, or below that of the least certain thousandth of the calibration rows if this is less.
REJECT = 0.5
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter[0]


def subwords(texts: list[str | None]):
    """For each size: the buckets of all subwords of the texts in order, and where each text's begin (one more than texts).

    Every text has a blank on either side, so that its subwords are the same whatever its neighbours are.
    """
    low = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, np.uint32(0))
    ends = np.cumsum([0, *map(len, low)])
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
            continue
        inside = is_letter[1 : m + 1].copy()
        if n == 2:
            inside |= is_letter[:m]
        for j in range(2, n - 1):
            inside &= is_letter[j : m + j]
        at = np.flatnonzero(inside)
        h = points[at] + np.uint32(n)
        for j in range(1, n):
            h = h * np.uint32(0x01000193) ^ points[at + j]
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), np.searchsorted(at, ends)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str | None]) -> np.ndarray:
    """The share of each bucket among a text's subwords, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for h, begin in subwords(texts):
        for i in range(len(texts)):
            out[i] += np.bincount(h[begin[i] : begin[i + 1]], minlength=BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for first, end in blocks(texts, 1 << 17):
            for h, begin in subwords(texts[first:end]):
                n[first:end] += np.diff(begin)
                for k in range(len(self.langs)):
                    sums = np.concatenate([[0.0], np.cumsum(self.table[:, k][h], dtype=np.float64)])
                    total[first:end, k] += np.diff(sums[begin])
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and calibrated scores."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        known = np.array([has_letter(t) for t in texts], bool)
        best = p.argmax(axis=1) if len(texts) else np.zeros(0, int)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1, initial=0), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(at: list[np.ndarray], share: list[np.ndarray], y: list[str], epochs: int = 16, rate: float = 1.0, batch: int = 16, seed: int = 1) -> Model:
    """Stochastic gradient descent on rows of buckets and their shares, with labels ``y``; every eighth row calibrates."""
    langs = sorted(set(y))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, REJECT)
    label = np.array([langs.index(v) for v in y])
    apart = np.arange(len(y)) % 8 == 7
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    learn = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    steps, step = epochs * -(-len(learn) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            lr = rate * (1 - step / steps)
            step += 1
            # The rows' buckets, each once, and their shares as a small dense table.
            used, place = np.unique(np.concatenate([at[r] for r in rows]), return_inverse=True)
            xb = np.zeros((len(rows), len(used)), np.float32)
            xb[np.repeat(np.arange(len(rows)), [len(at[r]) for r in rows]), place] = np.concatenate([share[r] for r in rows])
            m = xb @ e[used]
            g = softmax(m @ w + b).astype(np.float32)
            g[np.arange(len(rows)), label[rows]] -= 1
            back = g @ w.T
            w -= lr * (m.T @ g)
            b -= lr * 0.1 * g.sum(axis=0)
            e[used] -= lr * (xb.T @ back)
    table = (e @ w).astype(np.float32)
    rows = np.flatnonzero(apart) if apart.any() else learn
    z, t = np.array([share[r] @ table[at[r]] + b for r in rows], np.float64), label[rows]
    losses = {k: -np.log(np.maximum(softmax(z / k)[np.arange(len(t)), t], 1e-12)).mean() for k in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(losses, key=losses.get)
    sure = np.sort(softmax(z / temperature).max(axis=1))
    return Model(langs, table, b.astype(np.float64), temperature, float(min(REJECT, sure[len(sure) // 1000])))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and non-null lang of a bounded sample of the documents whose fold isn't 2.

    Features are counted on an executor and sent as sparse counts, ``BUCKETS`` at most for a row.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "text", "lang")

    def count(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                x = features(list(part["text"]))
                keep = [np.flatnonzero(r) for r in x]
                out = part[["lang"]].copy()
                out["at"] = [k.astype(np.int16) for k in keep]
                out["share"] = [r[k] for r, k in zip(x, keep, strict=True)]
                yield out

    found = bounded_sample(labelled, rows).mapInPandas(count, "lang string, at array<smallint>, share array<float>").toPandas()
    return train([np.asarray(a, np.int64) for a in found["at"]], [np.asarray(v, np.float32) for v in found["share"]], list(found["lang"]))


def prediction(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, rejected) of a text column. A filter on it stays behind it, so that each text is predicted once."""
    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts.to_pylist())
        rejected = [k == "und" or s < model.reject for k, s in zip(lang, score, strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred, score and rejected."""
    return docs.withColumn("_grovesift_p", prediction(F.col("text"), model)).withColumns({k: F.col("_grovesift_p")[k] for k in ("lang_pred", "score", "rejected")}).drop("_grovesift_p")


def held_out(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    p = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), prediction(F.col("text"), model).alias("p"))
    return p.select("doc_id", "held_out", "p.*")
