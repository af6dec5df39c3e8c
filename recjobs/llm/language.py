"""Language identification by hierarchy: first the family, then linear support vector machines,
one versus one, among the languages of that family.

Features are square-rooted, length-normalised counts of hashed byte n-grams (1 to 3) within words.
Models are fitted on a bounded sample of labelled rows (MAX_PER_LANGUAGE each), whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from recjobs.llm.textvec import LOWER, Texts, slices

_U = np.uint64
BUCKETS = 4096
MAX_PER_LANGUAGE = 600
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: ISO 639 codes and the family that tells them apart first; other codes are families of their own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}


def features(column: pa.Array) -> np.ndarray:
    """Rows of BUCKETS values, of length 1 (or 0, without any byte that counts)."""
    texts = Texts(column)
    n = len(texts)
    data = LOWER[texts.bytes]
    # whatever is no letter is a blank; so n-grams hold letters and the ends of words
    code = np.where(_ASCII_LETTER[data] | (data >= 128), data, 32).astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts.offsets))
    out = np.zeros((n, BUCKETS), np.float32)
    if not len(code):
        return out
    total = np.zeros(n * BUCKETS, np.int64)
    second = np.append(code[1:], np.uint32(32))
    third = np.append(code[2:], np.full(min(2, len(code)), 32, np.uint32))[: len(code)]
    same2 = np.append(doc[1:] == doc[:-1], False)
    same3 = np.append(doc[2:] == doc[:-2], np.zeros(min(2, len(doc)), bool))[: len(doc)]
    pair = code * np.uint32(256) + second
    for gram, keep in (
        (code, code != 32),
        (pair, same2 & (pair != 32 * 257)),
        (pair * np.uint32(256) + third, same3 & (second != 32)),
    ):
        salted = (gram + np.uint32(1)) * np.uint32(2654435761)
        bucket = (salted ^ (salted >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(20)
        total += np.bincount((doc * BUCKETS + bucket)[keep], minlength=n * BUCKETS)
    out = np.sqrt(total.reshape(n, BUCKETS).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script; nulls hold none."""
    texts = Texts(column)
    found = np.zeros(len(texts), bool)
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    found[doc[_ASCII_LETTER[texts.bytes]]] = True
    for i in np.flatnonzero(~found):
        found[i] = bool(column[i].is_valid and _LETTER.search(column[i].as_py()))
    return found


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150, rate: float = 20.0, l2: float = 1e-5) -> np.ndarray:
    """Weights of a softmax regression by gradient steps, classes weighing the same."""
    w = np.zeros((x.shape[1], classes), np.float32)
    target = np.eye(classes, dtype=np.float32)[y] / np.maximum(np.bincount(y, minlength=classes), 1)[y][:, None] / classes
    weight = target.sum(1, keepdims=True)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * (x.T @ (p * weight - target) + l2 * w)
    return w


def fit_svm(x: np.ndarray, sign: np.ndarray, steps: int = 200, l2: float = 1e-4) -> np.ndarray:
    """A linear support vector machine (squared hinge) by accelerated gradient steps."""
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w = previous = np.zeros(x.shape[1], np.float32)
    rate = 0.5 / (1.0 + l2)
    for k in range(steps):
        v = w + (k / (k + 3.0)) * (w - previous)
        loss = np.maximum(0, 1 - sign * (x @ v))
        previous, w = w, (v - rate * (l2 * v - 2 * (x.T @ (weight * sign * loss)))).astype(np.float32)
    return w


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILIES.get(lang, lang), []).append(lang)
        self.names = sorted(self.families)
        family = np.array([self.names.index(FAMILIES.get(lang, lang)) for lang in langs])
        self.family_weights = fit_softmax(x, family, len(self.names)) if len(self.names) else None
        self.machines: dict[tuple[str, str], np.ndarray] = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (langs == a) | (langs == b)
                self.machines[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and a score from 0 to 1 (family probability, times a sigmoid of the summed margins if the family has more languages)."""
        z = x @ self.family_weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        out, score = np.empty(len(x), object), p[np.arange(len(x)), best].astype(float)
        for f, name in enumerate(self.names):
            rows = np.flatnonzero(best == f)
            members = self.families[name]
            votes, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, b), w in self.machines.items():
                if a in members:
                    m = x[rows] @ w
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margin[:, i] += m
                    margin[:, j] -= m
            total = votes + 1e-3 * np.tanh(margin)  # ties go to the larger margin
            chosen = total.argmax(1) if len(members) > 1 else np.zeros(len(rows), int)
            out[rows] = np.array(members, object)[chosen]
            if len(members) > 1:
                score[rows] *= 1 / (1 + np.exp(-2 * margin[np.arange(len(rows)), chosen]))
        return out, np.clip(score, 0, 1)


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on at most MAX_PER_LANGUAGE rows of each language (those of least id hash), whole texts."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column(1)
                keep = np.flatnonzero(has_letter(column))
                x = features(column.take(pa.array(keep)))
                # counts of a row are recovered up to one factor: a byte a bucket keeps the sample small
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    # thin out before the exact cut, so that the window only orders a few rows of each language
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 1.5 * MAX_PER_LANGUAGE / n) * (1 << 30))))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = rows.filter(keep).withColumn("n", first).filter(F.col("n") <= MAX_PER_LANGUAGE).select("lang", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if rows:
            x = np.empty((len(rows), BUCKETS), np.float32)
            for k, (_, data) in enumerate(rows):
                x[k] = np.frombuffer(data, np.float16)
            model = LanguageModel(x, np.array([lang for lang, _ in rows], object))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the sample is bounded, so one task can fit it; the driver gets the weights alone
    fitted = sample.mapInArrow(vectors, "lang string, x binary").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else None


def identify_language(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_row: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document, by a model of the rows where ``learn`` holds;
    ``with_row`` adds the whole row as a struct.

    Text alone decides a prediction. A null text, or one without a letter, is ``und`` with score 0,
    and so is every text if no labelled row is there to learn from. Repeated rows get equal results;
    other columns are ignored; an empty table gives no rows.
    """
    model = fit_language_model(docs.filter(learn) if learn is not None else docs, id_col, text_col, lang_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1)
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), pc.struct_field(row, text_col), row], ["doc_id", "text", "row"])):
                column = part.column(1)
                langs, scores = np.full(len(column), "und", object), np.zeros(len(column))
                known = np.flatnonzero(has_letter(column)) if model else np.empty(0, int)
                for at in range(0, len(known), 512):
                    rows = known[at : at + 512]
                    langs[rows], scores[rows] = model.predict(features(column.take(pa.array(rows))))
                found = [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*found, part.column(2)] if with_row else found, schema.names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(docs.columns if with_row else [text_col])).alias("row"))
    schema = StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    schema = schema.add("row", source.schema["row"].dataType) if with_row else schema
    return source.mapInArrow(predict, schema)
