"""Language identification in two steps: family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams (one to three bytes, A-Z folded to lower case, digits alike)
of the whole text, as square-rooted frequencies of unit length. One linear SVM per pair of families picks the
family by vote, and one per pair of languages of that family picks the language. A text's
score is the product of the two steps' mean winning margins through the logistic function.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a learned
language outside the family table is a family of its own; with a single family or language
that step is certain; no labelled rows give ``und`` for every text; ties in votes go to the
larger summed margin, then to the first name; repeated rows are alike; other columns of the
input are kept and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.arrow_text import blocks

#: The usual family of each ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "hellenic": "el",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa sa ur",
    "dravidian": "kn ml ta te",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: The classifier is fitted on about this many labelled texts of each language at most.
SAMPLE_PER_LANGUAGE = 600
DIMENSIONS = 2048
#: Bytes of text whose n-grams are counted at a time.
_SLICE = 1 << 19
_STEPS, _RATE, _DECAY = 400, 2.0, 1e-4

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[48:58] = 48  # digits are alike
for _c in b"\t\n\v\f\r":
    _FOLD[_c] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``DIMENSIONS`` floats per text."""
    out = np.zeros((len(column), DIMENSIONS), dtype=np.float32)
    bits = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for start, end, data, offsets in blocks(column, _SLICE, 256):
        count = end - start
        if not len(data):
            continue
        total = np.zeros(count * DIMENSIONS)
        for begin in range(0, len(data), _SLICE):  # only a text longer than a block has more than one slice
            one = _FOLD[data[begin : begin + _SLICE + 2]]
            key, row = one.copy(), np.repeat(np.arange(count), np.diff(offsets)) if count > 1 else np.zeros(len(one), np.int64)
            for size in (1, 2, 3):
                if size > 1:
                    key = key[:-1] * np.uint64(257) + one[size - 1 :]
                n = min(_SLICE, len(key))
                own = row[:n] == row[size - 1 : size - 1 + n]
                slot = ((key[:n] + np.uint64(size << 40)) * _MIX) >> bits
                total += np.bincount((row[:n] * DIMENSIONS + slot.astype(np.int64))[own], minlength=count * DIMENSIONS)
        out[start:end] = np.sqrt(total).reshape(count, DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM by full-batch accelerated gradient steps; y is -1 or 1."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(_STEPS):
        loss = np.maximum(0, 1 - y * (x @ ahead)).astype(np.float32)
        gradient = _DECAY * ahead - x.T @ (loss * y * share).astype(np.float32)
        after = ahead - _RATE * 0.25 * gradient
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class PairwiseVote:
    """One-versus-one linear SVMs over ``names``."""

    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> PairwiseVote:
        names, fitted = tuple(sorted(set(labels.tolist()))), []
        for a, b in combinations(names, 2):
            own = (labels == a) | (labels == b)
            fitted.append(_fit_svm(x[own], np.where(labels[own] == a, 1.0, -1.0).astype(np.float32)))
        return cls(names, np.array([w for w, _ in fitted], np.float32).reshape(-1, x.shape[1]), np.array([b for _, b in fitted], np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``names`` and confidence of each row."""
        if len(self.names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights.T + self.bias
        votes, summed = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (i, j) in enumerate(combinations(range(len(self.names)), 2)):
            m = margin[:, k]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            summed[:, i] += m
            summed[:, j] -= m
        best = np.argmax(votes + np.tanh(summed) * 0.49, axis=1)
        mean = summed[np.arange(len(x)), best] / (len(self.names) - 1)
        return best, 1 / (1 + np.exp(-4 * mean))


@dataclass(frozen=True)
class LanguageModel:
    families: PairwiseVote | None
    within: dict[str, PairwiseVote]

    @classmethod
    def fit(cls, x: np.ndarray, languages: np.ndarray) -> LanguageModel:
        if not len(x):
            return cls(None, {})
        family = np.array([_FAMILY.get(lang.split("-")[0].lower(), lang) for lang in languages])
        return cls(PairwiseVote.fit(x, family), {f: PairwiseVote.fit(x[family == f], languages[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.families is None:
            return ["und"] * len(x), np.zeros(len(x))
        family, sure = self.families.predict(x)
        names = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families.names):
            own = np.flatnonzero(family == k)
            if len(own):
                vote = self.within[f]
                best, inner = vote.predict(x[own])
                names[own] = [vote.names[i] for i in best]
                sure[own] *= inner
        return names.tolist(), sure


@F.arrow_udf(T.BinaryType())
def _packed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([row.tobytes() for row in features(column)], pa.binary())


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with text and label: a hash of the text picks about ``sample_per_language`` texts of each label.

    A text counts once however many copies it has, so copies can neither fill the sample nor
    fall out of it together. Only the sample's feature rows (8 KB each) reach the driver; the
    labels are a list of languages, each with a count.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("mark")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "mark").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel(None, {})
    share = F.create_map(*[F.lit(v) for lang_, n in sizes.items() for v in (lang_, min(1.0, sample_per_language / n))])
    dice = F.pmod("mark", F.lit(1 << 30)).cast("double") / float(1 << 30)
    texts = rows.where(dice < F.element_at(share, F.col("lang"))).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    picked = texts.select("lang", _packed("text").alias("x")).collect()
    picked.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in picked), dtype=np.float32).reshape(len(picked), DIMENSIONS)
    return LanguageModel.fit(x, np.array([r["lang"] for r in picked], dtype=object).astype(str))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, scores = [], []
            for at in range(0, len(column), 256):
                some = column[at : at + 256]
                name, score = shared.value.predict(features(some))
                names += name
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])

    found = predict(F.col(text))
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.withColumn(into, found).withColumn(into, F.when(F.col(text).rlike(r"\p{L}"), F.col(into)).otherwise(unknown))
