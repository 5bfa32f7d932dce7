"""Quality by positive-unlabelled learning: non-negative unbiased risk, trusted positives, estimated class prior."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fold, text_udf
from tabloom.llm.sampling import labelled

#: Character classes: space, line end, lower case, upper case, digit, letter without case, then single signs, other signs, all else.
SIGNS = ".,;:!?'\"()[]{}<>/\\|#*&$%@_-+=~^`"
SPACE_, LINE, LOW, UP, DIGIT, LETTER = range(6)
OTHER_SIGN, REST = 6 + len(SIGNS), 7 + len(SIGNS)
CLASSES = 8 + len(SIGNS)
CHUNK = 1 << 20


def class_of(c: int) -> int:
    ch = chr(c)
    if ch == "\n":
        return LINE
    if ch.isspace():
        return SPACE_
    if ch in SIGNS:
        return 6 + SIGNS.index(ch)
    kind = unicodedata.category(ch)
    return {"Ll": LOW, "Lu": UP, "Lt": UP, "Nd": DIGIT}.get(kind, LETTER if kind[0] == "L" else OTHER_SIGN if kind[0] in "PS" else REST)


_classes: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _classes:
        _classes.append(np.array([class_of(c) if not 0xD800 <= c < 0xE000 else REST for c in range(1 << 16)], np.uint8))
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _classes[0][np.minimum(cp, 0xFFFF)]


WORD_STATS = 7
WIDTH = CLASSES + CLASSES * CLASSES + WORD_STATS


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and of pairs of neighbouring classes over the whole text, and word statistics.

    Shares are put on a logarithmic scale, since a document may be junk in part. An empty or null text is all zeros.
    """
    text = text or ""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    one, two = np.zeros(CLASSES), np.zeros(CLASSES * CLASSES)
    for s in range(0, len(text), CHUNK):
        k = classes(text[s:s + CHUNK + 1]).astype(np.int64)
        one += np.bincount(k[:CHUNK], minlength=CLASSES)
        two += np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES * CLASSES)
    out[:CLASSES] = np.log1p(1000 * one / len(text))
    out[CLASSES:-WORD_STATS] = np.log1p(1000 * two / len(text))
    words = text.split()
    if words:
        n = len(words)
        same = sum(a == b for a, b in zip(words, words[1:]))
        lines = text.split("\n")
        out[-WORD_STATS:] = (np.log1p(n), len(set(words)) / n, np.log1p(1000 * same / n), np.log1p(len(text) / n),
                             np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(1000 * len(set(words)) / (n + 1000)))
    return out


@dataclass
class QualityModel:
    """Linear model on scaled features; `prior` is the class prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: Column) -> Column:
        """P(good) of a text; null and empty texts get the score of a text without features."""
        def run(texts: list[str | None]) -> list[float]:
            return self.scores(np.stack([features(t) for t in texts]).astype(np.float64)).tolist()

        return text_udf(run, "double", pa.float64())(text)


def train_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 10) -> QualityModel:
    """Minimise prior E_P[l(z)] + max(0, E_U[l(-z)] - prior E_P[l(-z)]) with the logistic loss by Adam on mini-batches.

    Where the bracket is negative on a batch, the step goes up its slope, so that the negative part can't be
    fitted below zero. Without positives or unlabelled rows the score is the prior everywhere.
    """
    width, n = positive.shape[1], len(positive) + len(unlabelled)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    used = np.flatnonzero(positive.any(axis=0) | unlabelled.any(axis=0))  # most pairs of classes never occur
    mean, scale = np.zeros(width), np.full(width, 0.05)
    for j in used:  # column by column: no second copy of the sample
        x = [c[:, j].astype(np.float64) for c in (positive, unlabelled)]
        mean[j] = sum(c.sum() for c in x) / n
        scale[j] += np.sqrt(sum(((c - mean[j]) ** 2).sum() for c in x) / n)
    p, u = (np.clip((c[:, used] - mean[used].astype(np.float32)) / scale[used].astype(np.float32), -8, 8) for c in (positive, unlabelled))
    rng, w = np.random.default_rng(seed), np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for step in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        za, zb = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
        # l(z) = log(1 + e^-z); l(-z) = log(1 + e^z)
        pull = lambda x, g: np.append(x.T @ g, g.sum()) / len(x)
        good = prior * pull(a, -sig(-za))
        bad = pull(b, sig(zb)) - prior * pull(a, sig(za))
        below = soft(zb).mean() - prior * soft(za).mean() < 0
        g = -bad if below else good + bad
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights = np.zeros(width)
    weights[used] = w[:-1]
    return QualityModel(mean, scale, weights, float(w[-1]), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5,
                most_positive: int = 4_000, most_unlabelled: int = 8_000, prior: float | None = None, seed: int = 10) -> QualityModel:
    """Learn from at most most_positive trusted texts (label 1) and most_unlabelled texts of any kind, all from
    rows whose crc32(id) mod folds is not 0.

    The prior, unless given, is estimated as the share of label 1 among all labelled training rows, with one of
    each kind added. Labels outside 0 and 1 and null ids are left out; no texts of label 0 are read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    train = fold(F.col("id"), folds) != 0
    p, n_good = labelled(docs, labels, "label", 1, most_positive, id_col="id", train=train, seed=seed)
    u, _ = labelled(docs, labels, "label", None, most_unlabelled, id_col="id", train=train, seed=seed + 1)
    if prior is None:
        n_bad = labels.where(train & (F.col("label") == 0)).count()
        prior = (n_good + 1) / (n_good + n_bad + 2)

    def non_zero(texts: list[str | None]) -> list[bytes]:
        return [np.flatnonzero(x).astype(np.uint16).tobytes() + x[x != 0].tobytes() for x in map(features, texts)]

    packed = text_udf(non_zero, "binary", pa.binary())

    def gathered(rows: DataFrame) -> np.ndarray:
        got = sorted((r["id"], bytes(r["x"])) for r in rows.select("id", packed(F.col("text")).alias("x")).collect())  # a bounded sample
        out = np.zeros((len(got), WIDTH), np.float32)
        for row, (_, x) in zip(out, got, strict=True):
            n = len(x) // 6
            row[np.frombuffer(x, np.uint16, n)] = np.frombuffer(x[2 * n:], np.float32)
        return out

    return train_pu(gathered(p), gathered(u), prior, seed=seed)
