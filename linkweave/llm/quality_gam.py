"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a whole text is cut into quantile bins. Cyclic boosting visits the features in
turn and fits a shallow tree on that feature's bins to the current gradients of the logistic
loss; the trees of a feature add up to one lookup table. Pairs of features are ranked by how
much a coarse two-way table would still explain, and the best of them are boosted the same
way with trees of two cuts on each axis. A score is the logistic of the intercept plus one
table entry per feature and per pair, added up for all rows at once.

Defined cases: null and empty texts have all-zero features and are scored like any text; null
labels and labels other than 0 and 1 are not learnt from; no labelled rows give score 0.5, and
labels of one class only their smoothed share; a document with several labels is learnt once
per label; repeated rows score alike; columns of the input are kept and never read but for
the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.arrow_text import give_back, texts

#: About this many labelled rows are learnt from at most, picked by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Different texts of one labelled id that are learnt from.
TEXTS_PER_LABEL = 4
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE = 32, 120, 60, 8, 4, 0.15

FEATURES = ("log_words", "word_length", "upper_share", "digit_share", "stop_share", "symbol_share", "shout_share", "distinct_words", "distinct_trigrams", "repeated_lines", "words_per_line", "log_longest_word", "short_words", "marked_words", "non_ascii_share")

_KINDS = np.zeros(256, dtype=np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 8
_KINDS[list(b" \t\n\v\f\r")] = 4
_KINDS[list(b".,;:?'\"()-")] = 5
_KINDS[list(b"#*$%&|<>~^=_+{}[]\\/@`")] = 6
_KINDS[ord("!")] = 7


def _measure(raw: bytes) -> tuple[float, ...]:
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    size, letters = max(1, len(raw) - int(kinds[4])), max(1, int(kinds[1] + kinds[2]))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    lengths = list(map(len, words))
    symbols = b"#*$%&|<>!"
    return (
        np.log1p(n), size / n, kinds[2] / letters, kinds[3] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size,
        len(set(words)) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        np.log(max(lengths)), sum(x <= 2 for x in lengths) / n, sum(w[-1] in symbols for w in words) / n, kinds[8] / size,
    )


def measure(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    return np.array([_measure(t) for t in texts(column)], dtype=np.float64).reshape(len(column), len(FEATURES))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of each ordered bin: best-first splits of the bins' gradient sums."""
    total, mass = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))
    gain = lambda a, b: (total[b] - total[a]) ** 2 / (mass[b] - mass[a] + 1.0)
    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        best = None
        for a, b in spans:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                    best = gains[k], (a, b), int(at[k])
        if best is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(gradient))
    for a, b in spans:
        out[a:b] = (total[b] - total[a]) / (mass[b] - mass[a] + 1.0)
    return out


def _tree2(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same over a grid: the best cut on the first axis, then the best on the second in each part."""
    rows = _tree(gradient.sum(1), weight.sum(1), 2)
    out = np.empty_like(gradient)
    for value in set(rows.tolist()):
        own = rows == value
        out[own] = _tree(gradient[own].sum(0), weight[own].sum(0), 2)
    return out


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(x):
            return cls()
        share = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(share / (1 - share))))
        width = x.shape[1]
        model.cuts = [_cuts(x[:, j], BINS) for j in range(width)]
        model.coarse = [_cuts(x[:, j], 8) for j in range(width)]
        model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
        logit = np.full(len(y), model.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j in range(width):
                g, h = slopes()
                n = len(model.tables[j])
                step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n), LEAVES)
                model.tables[j] += step
                logit += step[bins[j]]
        grid = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
        cell = lambda i, j, v: np.bincount(grid[i] * (len(model.coarse[j]) + 1) + grid[j], v, (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)).reshape(len(model.coarse[i]) + 1, -1)
        g, h = slopes()
        worth = sorted(((float((cell(i, j, g) ** 2 / (cell(i, j, h) + 1)).sum()), i, j) for i, j in combinations(range(width), 2)), reverse=True)
        model.pairs = [(i, j) for _, i, j in worth[:PAIRS]]
        model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(model.pairs):
                g, h = slopes()
                step = RATE * _tree2(cell(i, j, g), cell(i, j, h))
                model.pair_tables[k] += step
                logit += step[grid[i], grid[j]]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            logit += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        if self.pairs:
            grid = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.coarse)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                logit += table[grid[i], grid[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array(list(measure(column)), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learn from labels of these documents; a hash of the id picks about ``sample_rows`` of them.

    A label that is given several times counts once. The picked labels (two numbers a row, bounded
    by that parameter) are broadcast. Their documents' features, and never their texts, come to the
    driver: of an id that stands with several texts those of ``TEXTS_PER_LABEL``, by their hashes,
    each once however often it is repeated.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").distinct()
    n = known.count()
    dice = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    picked = known.where(dice < int((1 << 30) * min(1.0, sample_rows / max(1, n))))
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    measured = rows.select("__id", F.col("__label").alias("y"), F.xxhash64("__text").alias("h"), _measured("__text").alias("x"))
    one = F.dense_rank().over(Window.partitionBy("__id", "y").orderBy("h"))
    kept = measured.withColumn("nth", one).where(F.col("nth") <= TEXTS_PER_LABEL).dropDuplicates(["__id", "y", "h"])
    got = sorted((r["y"], tuple(r["x"])) for r in kept.select("y", "x").collect())
    return AdditiveModel.fit(np.array([x for _, x in got], dtype=np.float64).reshape(len(got), len(FEATURES)), np.array([y for y, _ in got], dtype=np.float64))


def score(docs: DataFrame, model: AdditiveModel, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(shared.value.score(measure(column)))
        give_back()

    return docs.withColumn(into, run(F.col(text)))
