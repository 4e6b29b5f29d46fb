"""Byte-level BPE: speculate and verify.

A pre-token is cut by greedy longest match into tokens, which is a guess. The guess is right when every pair of
neighbouring tokens is compatible, that is when no merge over their border comes before the merges that made
the two of them; all pairs of all guessed pre-tokens are tested together in numpy. Pre-tokens with a pair that
fails are merged exactly. Both results go to a bounded cache, so each distinct pre-token costs once.

Why pairs are enough: undoing the merges of the left token along its right edge, and of the right token along
its left edge, shows which two pieces meet at the border at any time. A merge of two meeting pieces that ranks
before the merges which ended the meeting would have been taken; if there is none at any border, the sequence of
merges within the tokens is the one that BPE makes. Equal ranks are taken from left to right.

The vocabulary file's path is a parameter; each Python worker reads it once.

Defined results: a null text is encoded like an empty one, to no ids; a special token's string within a text is
that special token; repeated rows and null ids keep their rows; other columns stay.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, powers

# Fixed value: the pattern by which byte-level BPE cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids are kept, at most, and the longest that is.
CACHED, CACHED_LENGTH = 300_000, 64
NEVER = 1 << 40
#: Pre-tokens of more bytes are cut one by one, and verified together.
WIDE = 32
OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
_class: list[np.ndarray] = []


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def classes() -> np.ndarray:
    """The class of each code point in the pattern."""
    if not _class:
        table = np.zeros(0x110000, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        _class.append(table)
    return _class[0]


def pre_tokens(points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what ``PATTERN`` cuts texts into; at ``breaks`` stand marks between texts, which are left out.

    A token begins where the class changes. A blank before another class joins what follows; any other last
    white space of several stands alone; an apostrophe by itself takes a contraction's letters from the run
    behind it.
    """
    kind = classes()[points]
    kind[breaks] = BREAK
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[1:n] |= kind[1:] == BREAK
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 0x20
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-2] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(mark):
        a, b = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        size = np.where(one, 1, np.where(two, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        start[mark + 1 + size] = True
    at = np.flatnonzero(start)
    starts, stops = at[:-1], at[1:]
    real = kind[starts] != BREAK
    return starts[real], stops[real]


def span_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points."""
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts])


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letter = byte_letters()
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values(), 0)
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(letter[c] for c in token)
        self.id = {b: i for i, b in enumerate(self.bytes) if b}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        # rank of each token: 0 for single bytes, then by merge. Tokens are compared by rank, not by id.
        self.rank = np.zeros(size, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.pairs: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(file["model"]["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            c = self.id[self.bytes[a] + self.bytes[b]]
            self.pairs[a, b] = c
            if not self.rank[c]:
                self.rank[c], self.left[c], self.right[c] = k + 1, a, b
        self.merge_rank = {p: k + 1 for k, p in enumerate(self.pairs)}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.arange(1, len(keys) + 1)[order]
        self.pair_tokens = np.fromiter(self.pairs.values(), np.int64, len(keys))[order]
        # A token is only a safe guess if BPE makes it from its own bytes; others are never guessed.
        self.guess = {b: i for b, i in self.id.items() if len(b) < 2 or self.exact(b) == [i]}
        # A trie of the guessable tokens: sorted keys (node * 256 + byte) and the nodes they lead to.
        nodes: dict[bytes, int] = {b"": 0}
        for b in self.guess:
            for m in range(1, len(b) + 1):
                nodes.setdefault(b[:m], len(nodes))
        steps = np.array([[nodes[b[:-1]] * 256 + b[-1], i] for b, i in nodes.items() if i], np.int64)
        steps = steps[np.argsort(steps[:, 0])]
        self.step_keys, self.step_nodes = steps[:, 0].copy(), steps[:, 1].copy()
        self.node_token = np.array([self.guess.get(b, -1) for b in nodes], np.int64)
        self.longest = max(map(len, self.guess), default=0)
        self.single = np.array([self.id[bytes([b])] for b in range(256)])
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the cache of pre-tokens."""
        self.known: dict[int, int] = {}
        self.known_ids, self.known_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, hashes: list[int], counts: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(hashes, range(at, at + len(hashes)), strict=True))
        self.known_starts = np.concatenate([self.known_starts, self.known_starts[-1] + np.cumsum(counts)])
        self.known_ids = np.concatenate([self.known_ids, ids.astype(np.uint32)])

    def exact(self, word: bytes) -> list[int]:
        """BPE of one pre-token, by its rule: the merge of least rank first, the leftmost of equals."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks, merged = self.merge_rank, self.pairs
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := ranks.get((a, b)))]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else end
            if j == end or ids[j] != b:
                continue
            ids[i], ids[j] = merged[a, b], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if r := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (r := ranks.get((ids[p], ids[i]))):
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def exact_all(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many short pre-tokens (rows of bytes, padded) at once: a merge in each row at a time."""
        tokens = np.where(np.arange(letters.shape[1]) < lengths[:, None], self.single[letters], -1)
        counts, rows = lengths.copy(), np.arange(len(letters))
        out = tokens.copy()
        t, ranks = tokens, self.look(tokens[:, :-1], tokens[:, 1:])[0]
        place = np.arange(tokens.shape[1])
        while len(rows):
            i = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            on = ranks[line, i] < NEVER
            out[rows[~on]] = t[~on]
            rows, t, ranks, i = rows[on], t[on], ranks[on], i[on]
            if not len(rows):
                break
            line = np.arange(len(rows))
            counts[rows] -= 1
            t[line, i] = self.look(t[line, i], t[line, i + 1])[1]
            from_ = np.minimum(place + (place > i[:, None]), len(place) - 1)
            t = np.take_along_axis(t, from_, axis=1)
            t[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(from_[:, :-1], ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NEVER
            for j in (i - 1, i):
                ok = np.flatnonzero((j >= 0) & (j < ranks.shape[1]))
                ranks[ok, j[ok]] = self.look(t[ok, j[ok]], t[ok, j[ok] + 1])[0]
        return out, counts

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the merge of a and b; NEVER where there is none."""
        keys = (a << 32) | np.where(a < 0, 0xFFFFFFFF, b & 0xFFFFFFFF)
        k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[k] == keys
        return np.where(hit, self.pair_ranks[k], NEVER), self.pair_tokens[k]

    def greedy_all(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest guessable token at each place of many pre-tokens, by walking the trie with all of them at once."""
        n, width = letters.shape
        out, counts = np.full((n, width), -1, np.int64), np.zeros(n, np.int64)
        row, at, node = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        token, upto = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        while len(row):
            size = lengths[row]
            keys = node * 256 + letters[row, np.minimum(at, width - 1)]
            k = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
            hit = (at < size) & (self.step_keys[k] == keys)
            node = np.where(hit, self.step_nodes[k], 0)
            at = at + hit
            ends = hit & (self.node_token[node] >= 0)
            token, upto = np.where(ends, self.node_token[node], token), np.where(ends, at, upto)
            lost = np.flatnonzero(~hit)
            r = row[lost]
            out[r, counts[r]] = token[lost]
            counts[r] += 1
            at[lost] = upto[lost]
            left = hit | (upto < size)
            row, at, node, token, upto = row[left], at[left], node[left], token[left], upto[left]
        return out, counts

    def greedy(self, word: bytes) -> list[int]:
        """The longest guessable token at each place of one pre-token."""
        out, at, guess = [], 0, self.guess
        while at < len(word):
            n = min(self.longest, len(word) - at)
            while n > 1 and word[at : at + n] not in guess:
                n -= 1
            out.append(guess[word[at : at + n]])
            at += n
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between neighbouring tokens a and b, for many pairs."""
        last = np.iinfo(np.int64).max
        kept = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        ended_x, ended_y = np.full(len(a), last), np.full(len(a), last)  # ranks of the merges that ended the pieces x and y
        while len(at):
            keys = x << 32 | y
            k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            met = np.where(self.pair_keys[k] == keys, self.pair_ranks[k], last)
            # A merge of equal rank inside a lies left of the border and goes first; one inside b goes after.
            crossed = (met < ended_x) & (met <= ended_y) & (met < last)
            kept[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            on = ~crossed & ((rx > 0) | (ry > 0))
            ended_x, ended_y = np.where(undo_x, rx, ended_x), np.where(undo_x, ended_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            at, x, y, ended_x, ended_y = at[on], x[on], y[on], ended_x[on], ended_y[on]
        return kept

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, flat, and how many each has: guessed, verified, merged exactly where a pair fails."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        counts, parts = np.zeros(len(raw), np.int64), []
        for low, high in ((0, 8), (8, 16), (16, WIDE)):
            for some in np.array_split(w := np.flatnonzero((sizes > low) & (sizes <= high)), len(w) // 50_000 + 1):
                lengths = sizes[some]
                letters = np.zeros((len(some), high), np.int64)
                inside = np.arange(high) < lengths[:, None]
                letters[inside] = np.frombuffer(b"".join([raw[k] for k in some]), np.uint8)
                ids, n = self.greedy_all(letters, lengths)
                pair = np.arange(high - 1) < n[:, None] - 1
                a, b = ids[:, :-1][pair], ids[:, 1:][pair]
                each, back = np.unique(a << 32 | b, return_inverse=True)
                owner = np.nonzero(pair)[0]
                wrong = np.unique(owner[~self.compatible(each >> 32, each & 0xFFFFFFFF)[back]])
                ids[wrong], n[wrong] = self.exact_all(letters[wrong], lengths[wrong])
                counts[some] = n
                parts.append((some, n, ids[np.arange(high) < n[:, None]]))
        wide = np.flatnonzero(sizes > WIDE)
        if len(wide):
            guesses = [np.array(self.greedy(raw[k]), np.int64) for k in wide]
            ids, n = np.concatenate(guesses), np.fromiter(map(len, guesses), np.int64, len(wide))
            owner = np.repeat(np.arange(len(wide)), n)
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            each, back = np.unique(ids[pair] << 32 | ids[pair + 1], return_inverse=True)
            for w in np.unique(owner[pair][~self.compatible(each >> 32, each & 0xFFFFFFFF)[back]]).tolist():
                guesses[w] = np.array(self.exact(raw[wide[w]]), np.int64)
            n = np.fromiter(map(len, guesses), np.int64, len(wide))
            counts[wide] = n
            parts.append((wide, n, np.concatenate(guesses)))
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        for some, n, ids in parts:
            flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts without special tokens, in order, and where each text's begin (one more than texts)."""
        import pandas as pd

        joined = "\0".join([*(t or "" for t in texts), ""])
        ends = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, stops = pre_tokens(points, ends[1:] - 1)
        hashes = span_hashes(points, starts, stops)
        codes, each = pd.factorize(hashes)
        first = np.zeros(len(each), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        keys = each.tolist()
        if len(self.known) + len(keys) > CACHED:
            self.forget()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        raw = [joined[a:b].encode() for a, b in zip(starts[first[fresh]].tolist(), stops[first[fresh]].tolist(), strict=True)]
        flat, counts = self.encode_words(raw)
        self.add([keys[k] for k in fresh], counts, flat)
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[codes]
        lengths = np.diff(self.known_starts)[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.known_ids[np.repeat(self.known_starts[at] - upto[:-1], lengths) + np.arange(upto[-1])]
        if len(self.known) > CACHED or any(len(w) > CACHED_LENGTH for w in raw):
            self.forget()
        return ids, upto[np.searchsorted(starts, ends)]

    def encode_one(self, text: str) -> np.ndarray:
        """The ids of a text in which special tokens may stand."""
        parts = self.specials.split(text)
        out = [np.array([self.special[p]], np.uint32) if k % 2 else self.encode_block([p])[0] for k, p in enumerate(parts)]
        return np.concatenate(out)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Pre-tokens are told apart by 64-bit hashes; that each text comes back from its ids shows that none were mistaken."""
        out: list[np.ndarray] = []
        marked = {k: t for k, t in enumerate(texts) if t and any(s in t for s in self.special)}
        plain = [None if k in marked else t for k, t in enumerate(texts)] if marked else texts
        for first, end in blocks(plain, 1 << 18):
            ids, at = self.encode_block(plain[first:end])
            if self.join(ids) != "".join(t or "" for t in plain[first:end]).encode():
                self.forget()
                ids = [np.concatenate([np.zeros(0, np.uint32), *(np.array(self.exact(w.encode()), np.uint32) for w in regex.findall(PATTERN, t or ""))]) for t in plain[first:end]]
                out += ids
            else:
                out += [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k, t in marked.items():
            out[k] = self.encode_one(t)
        return out

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, special tokens included."""
        ids = np.asarray(ids, np.int64)
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included."""
        return self.join(ids).decode("utf-8", "replace")


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of ids of a text column."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = tokenizer(path).encode_batch(texts.to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)))
        tokenizer(path).forget()  # the worker lives on

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids (null for null)."""
    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        # By views of the flat values: as Python lists the ids of a batch would take several hundred MB.
        at, flat, there = rows.offsets.to_numpy(), rows.values.to_numpy(), rows.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([tokenizer(path).decode(flat[a:b]) if ok else None for a, b, ok in zip(at, at[1:], there, strict=False)], pa.string())

    return text(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits each) and of the text decoded from them."""
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for texts in batches:
            ids = t.encode_batch(texts.to_pylist())
            columns = [len(x) for x in ids], [sha(x.astype("<u4").tobytes()) for x in ids], [sha(t.decode(x).encode()) for x in ids]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
