"""Toxicity with noisy-channel deobfuscation.

A character language model (trigrams, counted over the words of all documents) decodes each
suspicious token's lattice by Viterbi: a leet character may stand for letters, a run of one letter
for one or two, and marks or blanks between letters for nothing. Plain and restored words are then
scored by a logistic model of the words that tell the labels apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recjobs.llm.textvec import Texts, slices

_U = np.uint64
WORD_BITS = 18  # hashed words of the label statistics
STEM_BYTES = (4, 5, 6)
MAX_FEATURES = 512
MIN_RATIO = 30.0  # log-likelihood ratio of a feature: far beyond chance for 2**WORD_BITS words
MAX_LABELLED = 100_000  # labelled rows that are learned from (those of least id hash); so they may be broadcast
MAX_FITTED = 10_000  # of these, rows on which the logistic model is fitted
CACHE_TOKENS = 200_000
TOKEN_CHARS = 64  # longer tokens aren't remembered
STRETCHES = range(4, 13)  # lengths of words among letters that stand singly or are repeated

#: Letters that a character may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = "._-*~ ,/\\'`"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[ord(c) for c in "._-*~"]] = True


# ---------------------------------------------------------------- the channel


class Channel:
    """Trigram model over a-z and the word end (index 26), and the decoder of lattices."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27, 27).astype(float)
        two, one = c.sum(0), c.sum((0, 1))  # of (b, x) and of x
        p1 = (one + 0.5) / (one.sum() + 13.5)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()
        self.known: dict[str, str] = {}

    def lattice(self, token: str) -> list[list[str]]:
        """For each group of equal characters the strings that it may stand for."""
        groups, i = [], 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            ch, n = token[i], j - i
            if ch in ALPHABET:
                groups.append([ch, ch * 2] if n > 1 else [ch])
            elif ch in LEET:
                inner = [x if n == 1 else y for x in LEET[ch] for y in (x, x * 2)]
                groups.append(list(dict.fromkeys(inner)) + ([""] if ch in "!|(+$" else []))
            elif ch in SEPARATORS:
                groups.append([""])
            else:
                groups.append([ch])  # a letter beyond a-z, or a mark: as it is
            i = j
        return groups

    def restore(self, token: str) -> str:
        """The likeliest reading; costs are per string, so shorter readings have no discount but the
        word end's."""
        hit = self.known.get(token)
        if hit is not None:
            return hit
        # a reading is a chain of (chain before, string), so a step costs the same however long it is
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(26, 26): (0.0, None)}
        for group in self.lattice(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, chain) in states.items():
                for option in group:
                    x, y, total = a, b, cost + (1.5 if not option and group != [""] else 0.0)
                    for ch in option:
                        z = ord(ch) - 97 if ch in ALPHABET else 26
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, (chain, option)
            states = new
        ended = [(cost + self.cost[a][b][26], chain) for (a, b), (cost, chain) in states.items()]
        least = min(cost for cost, _ in ended)
        out = min(self._text(chain) for cost, chain in ended if cost == least)
        if len(token) <= TOKEN_CHARS:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            self.known[token] = out
        return out

    @staticmethod
    def _text(chain: tuple | None) -> str:
        parts = []
        while chain is not None:
            chain, option = chain
            parts.append(option)
        return "".join(reversed(parts))


def letter_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: starts, ends, and each text's first run."""
    return texts.ranges(_LETTER[texts.bytes])


def suspicious(texts: Texts) -> list[tuple[int, str]]:
    """``(text, token)``: blank-free tokens with leet characters beside letters, letters said three
    times, or marks between single letters; and runs of three or more single letters."""
    data = texts.bytes
    n = len(data)
    if n < 3:
        return []
    starts, ends, first = texts.words()
    ascii_, leet = _ASCII[data], _LEET[data]
    flag = np.zeros(n, bool)
    flag[1:] |= leet[1:] & ascii_[:-1]
    flag[:-1] |= leet[:-1] & ascii_[1:]
    flag[2:] |= ascii_[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    joins = _JOINS[data]
    flag[1:-1] |= joins[1:-1] & ascii_[:-2] & ascii_[2:]
    sums = np.concatenate([[0], np.cumsum(flag)])
    hit = np.flatnonzero(sums[ends] > sums[starts])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    out = []
    for k in hit.tolist():
        token = bytes(data[starts[k] : ends[k]]).decode(errors="replace").strip(".,;:?\"'*#%&-_~)")
        core = token.rstrip("!$|")
        if len(token) - len(core) > 1 or not any(c in LEET for c in core):
            token = core if core else token
        out.append((int(doc[k]), token))
        if core != token and core:
            out.append((int(doc[k]), core))
    # letters with blanks between them: runs of one-letter words
    single = (ends - starts == 1) & (ascii_[starts] | leet[starts])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        cuts = [a, *(c for c in first.tolist() if a < c < b), b] if doc[a] != doc[b - 1] else [a, b]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y - x >= 3:
                out.append((int(doc[x]), bytes(data[starts[x:y]]).decode()))
    return out


# ---------------------------------------------------------------- statistics over the corpus


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Counters of a fixed number of cells, added up over tasks; the result alone is collected."""
    out = np.zeros(size, np.int64)
    sums = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _cells(counts: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["cell", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> Channel:
    """Trigrams of all letter runs of a-z of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(27**3, np.int64)
        code = np.full(256, 26, np.int64)
        code[97:123] = np.arange(26)
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column(0), lower=True)
                c = code[texts.bytes]
                c = np.concatenate([[26, 26], c, [26, 26]])
                counts += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)
        # runs of non-letters are no words
        counts.reshape(27, 27, 27)[26, 26, 26] = 0
        yield _cells(counts)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "cell long, n long")
    return Channel(_summed(rows, 27**3))


def _stems(texts: Texts, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and their beginnings of STEM_BYTES: compounds and endings share those."""
    docs, hashes = [doc], [texts.hashes(starts, ends)]
    for n in STEM_BYTES:
        longer = ends - starts > n
        docs.append(doc[longer])
        hashes.append(texts.hashes(starts[longer], starts[longer] + n))
    return np.concatenate(docs), np.concatenate(hashes)


def _word_hashes(texts: Texts, channel: Channel) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, hash)`` of letter runs and restored tokens, with their stems, by parts."""
    starts, ends, first = letter_runs(texts)
    yield _stems(texts, np.repeat(np.arange(len(texts)), np.diff(first)), starts, ends)
    docs, words, whole = [], [], []
    for d, token in suspicious(texts):
        docs.append(d)
        words.append(channel.restore(token))
        whole.append(len(token) > 2 and all(c in ALPHABET for c in token) and " " not in token)
    if not words:
        return
    extra, doc = Texts(pa.array(words, pa.string())), np.array(docs)
    yield _stems(extra, doc, extra.offsets[:-1], extra.offsets[1:])
    # single letters may be several words: every stretch of them, a length at a time
    some = np.array(whole)
    at = np.flatnonzero(np.repeat(some, np.diff(extra.offsets)))
    word = np.repeat(np.arange(len(words)), np.diff(extra.offsets))[at]
    for n in STRETCHES:
        inside = at + n <= extra.offsets[word + 1]
        at, word = at[inside], word[inside]
        yield doc[word], extra.hashes(at, at + n)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - WORD_BITS)).astype(np.int64)


class ToxicityModel:
    def __init__(self, channel: Channel, features: np.ndarray, weights: np.ndarray, bias: float):
        self.channel, self.features, self.weights, self.bias = channel, features, weights, bias
        self.place = np.full(1 << WORD_BITS, -1, np.int32)
        self.place[features] = np.arange(len(features))

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Which feature words each text holds."""
        texts = Texts(column, lower=True)
        out = np.zeros((len(texts), max(len(self.features), 1)), np.float32)
        for doc, h in _word_hashes(texts, self.channel):
            at = self.place[_bucket(h)]
            out[doc[at >= 0], at[at >= 0]] = 1
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.features):
            z = np.full(len(column), self.bias)
        else:
            z = self.matrix(column) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, l2: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression of rows that count ``times`` by accelerated gradient steps,
    the intercept free."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = (times / times.sum()).astype(np.float32)
    w = previous = np.zeros(x1.shape[1], np.float32)
    rate = np.float32(4.0 / max(float(share @ (x1**2).sum(1)), 1.0))
    penalty = np.full(len(w), l2, np.float32)
    penalty[-1] = 0
    for k in range(steps):
        v = w + np.float32(k / (k + 3.0)) * (w - previous)
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -40, 40)))
        previous, w = w, v - rate * (x1.T @ (share * (p - y)) + penalty * v)
    return w[:-1].astype(float), float(w[-1])


def _thinned(marks: DataFrame, most: int) -> DataFrame:
    """All rows if they are few, else about ``most`` of them, by a hash of the id."""
    share = min(1.0, most / max(marks.count(), 1))
    return marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents where ``learn`` (on ``doc_id``) holds; the channel from all."""
    channel = character_model(docs, text_col)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = _thinned(marks.filter(learn if learn is not None else F.lit(True)), MAX_LABELLED)
    known = source.join(F.broadcast(marks), "doc_id")

    size = 1 << WORD_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * size + 2, np.int64)
        for batch in batches:
            for part in slices(batch):
                label = part.column(2).to_numpy().astype(np.int64)
                texts = Texts(part.column(1), lower=True)
                pair = np.unique(np.concatenate([np.unique(doc * size + _bucket(h)) for doc, h in _word_hashes(texts, channel)]))
                counts += np.bincount(label[pair // size] * size + pair % size, minlength=len(counts))
                counts[2 * size :] += np.bincount(label, minlength=2)
        yield _cells(counts)

    counts = _summed(known.mapInArrow(count, "cell long, n long"), 2 * size + 2)
    n = counts[2 * size :]
    if not n.all():  # one label alone: a constant
        return ToxicityModel(channel, np.empty(0, np.int64), np.empty(0), math.log((n[1] + 0.5) / (n[0] + 0.5)))
    with_word = counts[: 2 * size].reshape(2, size)
    # how far a word's counts are from no difference between the labels (log-likelihood ratio)
    total, seen = n.sum(), with_word.sum(0)
    g2 = np.zeros(size)
    for label in (0, 1):
        for have, of in ((with_word[label], seen), (n[label] - with_word[label], total - seen)):
            expected = of * (n[label] / total)
            g2 += 2 * have * np.log(np.maximum(have, 1) / np.maximum(expected, 1e-9))
    strong = np.argsort(-g2, kind="stable")[:MAX_FEATURES]
    features = np.sort(strong[g2[strong] > MIN_RATIO])
    model = ToxicityModel(channel, features, np.zeros(len(features)), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = model.matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([np.flatnonzero(r).astype(np.int32).tobytes() for r in x], pa.binary())], ["label", "x"])

    sample = source.join(F.broadcast(_thinned(marks, MAX_FITTED)), "doc_id")
    # equal rows are counted together: what is collected is bounded by MAX_FITTED in any case
    rows = sample.select("doc_id", "text", "label").mapInArrow(vectors, "label int, x binary").groupBy("label", "x").count().collect()
    x, y = np.zeros((len(rows), max(len(features), 1)), np.float32), np.zeros(len(rows), np.float32)
    times = np.zeros(len(rows), np.int64)
    for k, r in enumerate(sorted(rows, key=lambda r: (r.label, bytes(r.x)))):
        x[k, np.frombuffer(r.x, np.int32)] = 1
        y[k], times[k] = r.label, r["count"]
    if len(features) and len(rows):
        model.weights, model.bias = fit_logistic(x, y, times)
    else:
        model.features, model.bias = np.empty(0, np.int64), math.log((n[1] + 0.5) / (n[0] + 0.5))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, score, predicted)`` of every document.

    A null or empty text has no word and gets the model's score of that; labels other than 0 and 1
    are not learned from, and of several for one document the largest counts. Without both labels the
    score is their smoothed share. Repeated rows get equal scores; other columns are ignored; an
    empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, learn, id_col, text_col, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = model.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(score, "doc_id long, score double, predicted int")
