r"""Secret scans: fixed patterns, and strings that two character Markov models tell to be random.

Both models are second-order chains over ``ALPHABET``, smoothed by first-order ones: one learned from random strings,
one from ordinary identifiers, numbers and words. A run of 16 or more characters that overlaps no pattern match is a
secret when its log-likelihood ratio is over a threshold: the ratio that one in ``1 / FALSE`` ordinary strings of a
calibration part, which neither chain has seen, goes beyond.

The labelled samples are strings made by a seeded generator (random) and, as ordinary ones, the words of a
bounded sample of the corpus, numbers, and identifiers composed of such words.

Defined results: a null or empty text has no spans; repeated rows and null ids keep their rows; columns of the
input stay, but for one called like the result, which it replaces; without any ordinary words in the corpus the
composed identifiers and numbers alone are learned.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # leftmost, so whole runs
KINDS = ("assign", "access", "hex", "random")
WORDS_OF_ASSIGN = ("passw", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SPAN = "array<struct<kind:string,start:int,end:int>>"
#: Rows of the corpus from which ordinary words are learned, at most.
SAMPLE_ROWS = 1000
#: Least log-likelihood ratio of a secret, and the share of ordinary calibration strings that may be beyond the threshold.
LEAST, FALSE = 8.0, 1 / 2000
#: Of how many counts the first-order chain's say in the second-order one is worth.
PRIOR = 4.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of the fixed patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


@dataclass
class Model:
    ratio: np.ndarray  # log P(next | last two, random) - log P(next | last two, ordinary)
    threshold: float

    def score(self, s: str) -> float:
        codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        return float(self.ratio[codes[:-2], codes[1:-1], codes[2:]].sum())

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans of a text, by start and then kind."""
        out = base_spans(text)
        taken = [(a, b) for _, a, b in out]
        found = [
            ("random", m.start(), m.end())
            for m in CANDIDATE.finditer(text)
            if not any(a < m.end() and m.start() < b for a, b in taken) and self.score(m[0]) > self.threshold
        ]
        return sorted(out + found, key=lambda x: (x[1], KINDS.index(x[0])))


def chain(samples: list[str]) -> np.ndarray:
    """Log probabilities of a character after two others; after one other, where these two are rare."""
    n = len(ALPHABET)
    two, three = np.full((n, n), 0.5), np.zeros((n, n, n))
    for s in samples:
        codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(two, (codes[:-1], codes[1:]), 1)
        np.add.at(three, (codes[:-2], codes[1:-1], codes[2:]), 1)
    first = two / two.sum(axis=1, keepdims=True)
    return np.log((three + PRIOR * first) / (three.sum(axis=2, keepdims=True) + PRIOR))


def random_strings(n: int, seed: int = 5) -> list[str]:
    """Labelled ``random``: keys over the usual alphabets."""
    rng = random.Random(seed)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef")
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 64))) for i in range(n)]


def ordinary_strings(words: list[str], n: int, seed: int = 6) -> list[str]:
    """Labelled ``ordinary``: the words, identifiers made of them, numbers, dates and rulers."""
    rng = random.Random(seed)
    words = words or ["value", "index", "number", "of", "the", "file", "name", "with", "default", "config", "user", "path", "list"]

    def one(i: int) -> str:
        some = [rng.choice(words) for _ in range(rng.randint(2, 5))]
        kind = i % 7
        if kind == 0:
            return "".join(w.capitalize() for w in some)
        if kind == 1:
            return some[0].lower() + "".join(w.capitalize() for w in some[1:])
        if kind == 2:
            return "".join(rng.choices(string.digits, k=rng.randint(8, 24)))
        if kind == 3:
            return rng.choice("-_=+/") * rng.randint(16, 60)
        if kind == 4:
            return f"{rng.choice(some).upper()}_{rng.randint(0, 99999)}"
        joint = "_-/"[i % 3]
        return joint.join(some).lower() if kind == 5 else joint.join(some).upper()

    return words + [one(i) for i in range(n)]


def train(words: list[str], n: int = 20_000) -> Model:
    words = sorted({w for w in words if len(w) > 1})
    ordinary = ordinary_strings(words, n)
    held, learned = ordinary[::5], [s for i, s in enumerate(ordinary) if i % 5]
    ratio = chain(random_strings(n)) - chain(learned)
    model = Model(ratio, -math.inf)
    scores = np.sort([model.score(s) for s in held if len(s) > 15])
    model.threshold = max(LEAST, float(scores[-1 - int(FALSE * len(scores))]) if len(scores) else LEAST)
    return model


def corpus_words(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = 20_000) -> list[str]:
    """The ``most`` smallest-hashed ASCII words of a bounded sample of documents, without those in pattern matches.

    The bound keeps what is sent to the driver small; a word's own hash chooses, so the choice is the same on every run.
    """
    sample = bounded_sample(docs.select("doc_id", "text"), rows)
    word = F.explode(F.split(F.regexp_replace("text", "[A-Za-z0-9+/_.=-]{24,}", " "), "[^A-Za-z]+")).alias("w")
    found = sample.select(word).filter(F.length("w") > 1).distinct()
    return [r[0] for r in found.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def fit(docs: DataFrame) -> Model:
    return train(corpus_words(docs))


def span_column(text: Column, model: Model) -> Column:
    """All spans of a text column, as ``SPAN``; ends are exclusive, in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in model.spans(t or "")] for t in texts.to_pylist()], kind)

    return spans(text)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with each run of overlapping secret spans replaced by ``[SECRET]``; all columns stay."""
    @F.arrow_udf("string")
    def hide(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t:
                end, parts = 0, []
                for _, a, b in model.spans(t):
                    if a >= end:
                        parts += [t[end:a], "[SECRET]"]
                    end = max(end, b)
                t = "".join([*parts, t[end:]]) if parts else t
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn("text", hide("text"))


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans as a string."""
    s = docs.select("doc_id", span_column(F.col("text"), model).alias("s"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.sha2(said(F.filter("s", lambda x: x["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("s")).alias("spans"), count("random"),
    )


def base_counts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and how many spans of each base kind a document has."""
    return digests(docs, model).select("doc_id", "n_assign", "n_access", "n_hex")


ORACLE_COUNTS = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''),
    '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
    lambda x: length(x) >= 8))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
FROM documents
"""
