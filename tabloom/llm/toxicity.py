"""Toxicity: character n-gram embeddings, averaged over a window of words, into a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fold, text_udf
from tabloom.llm.sampling import labelled

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
GAP = 32
CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    """Lower-case code points; whatever is neither letter nor digit becomes a gap."""
    if not _letters:
        _letters.append(np.array([not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or 0x300 <= c < 0x370) for c in range(1 << 16)]))
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where((cp > 0xFFFF) | _letters[0][np.minimum(cp, 0xFFFF)], cp, GAP)


def subwords(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every n-gram of " word ", words counted from 0 in the order of the text."""
    cp = np.concatenate([[GAP], cp, [GAP]]).astype(np.uint64)
    gap = cp == GAP
    start = np.flatnonzero(gap[:-1] & ~gap[1:])  # the gap before each word
    gaps = np.concatenate([[0], np.cumsum(gap)])
    all_b, all_w = [], []
    for n in GRAMS:
        if len(cp) < n:
            continue
        m = len(cp) - n + 1
        inside = gaps[n - 1:n - 1 + m] - gaps[1:1 + m]  # gaps strictly inside
        at = np.flatnonzero(inside == 0)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + cp[at + k]
            h ^= h >> np.uint64(29)
        all_b.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        all_w.append(np.searchsorted(start, at, "right") - 1)
    if not all_b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_b), np.concatenate(all_w)


def best_window(sums: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents made of words first..last-1 (none empty): the highest mean over k words in a row, and where it starts."""
    s, c = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    i = np.arange(len(sums))
    doc = np.repeat(np.arange(len(first)), last - first)
    end = np.minimum(i + k, last[doc])
    mean = (s[end] - s[i]) / np.maximum(1, c[end] - c[i])
    mean[i > np.maximum(last[doc] - k, first[doc])] = -np.inf
    top = np.maximum.reduceat(mean, first)
    hit = np.flatnonzero(mean == top[doc])
    return top, hit[np.unique(doc[hit], return_index=True)[1]]


@dataclass
class ToxicityModel:
    """Bucket embeddings and softmax, folded into one number per bucket (the difference of the two classes)."""

    slope: np.ndarray
    bias: float
    window: int

    def logit(self, text: str | None) -> float:
        """Highest window of a whole text; long texts go through in overlapping pieces of whole words."""
        cp, best = code_points(text or ""), -np.inf
        start = 0
        while start < len(cp):
            stop = min(len(cp), start + CHUNK)
            if stop < len(cp):
                gaps = np.flatnonzero(cp[start:stop] == GAP)
                stop = start + int(gaps[-1]) + 1 if len(gaps) else len(cp)
            b, w = subwords(cp[start:stop])
            if len(w):
                n = int(w.max()) + 1
                sums, counts = np.bincount(w, self.slope[b], n), np.bincount(w, minlength=n)
                best = max(best, float(best_window(sums, counts, np.array([0]), np.array([n]), self.window)[0][0]))
            if stop == len(cp):
                break
            words = np.flatnonzero((cp[start:stop] == GAP)[:-1] & (cp[start:stop] != GAP)[1:])
            start = start + int(words[-(self.window - 1)]) if len(words) >= self.window else stop  # the next piece repeats window - 1 words
        return self.bias + (best if np.isfinite(best) else 0.0)

    def score(self, text: Column) -> Column:
        """P(toxic); texts without words get the softmax of the bias alone."""
        def run(texts: list[str | None]) -> list[float]:
            return (1 / (1 + np.exp(-np.clip([self.logit(t) for t in texts], -30, 30)))).tolist()

        return text_udf(run, "double", pa.float64())(text)


def word_parts(words: list[bytes], size: int = 20_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of distinct words (code points as bytes), word by word, with the start of each word: in parts of
    bounded size, so that what a pass over them needs stays small."""
    out, gap = [], np.array([GAP], np.uint32).tobytes()
    for s in range(0, len(words), size):
        part = words[s:s + size]
        bucket, owner = subwords(np.frombuffer(gap.join(part), np.uint32))
        out.append((bucket[np.argsort(owner, kind="stable")].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(part)))])))
    return out


def train_bags(texts: list[str], labels: np.ndarray, *, size: int = 16, window: int = 3, steps: int = 120, rate: float = 0.1, seed: int = 5) -> ToxicityModel:
    """Embeddings and softmax trained jointly by Adam on all texts at once.

    The first tenth of the steps averages whole documents, the rest the window that scores highest, so that a
    long text is judged by its worst passage. With a two-class softmax the slope of the loss for a bucket is one
    number times the difference of the class vectors, so all counting is by bincount.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in texts:
        cp = code_points(text or "")
        edges = np.flatnonzero(np.diff(np.concatenate([[True], cp == GAP, [True]]).astype(np.int8)))
        words = [vocabulary.setdefault(cp[a:b].tobytes(), len(vocabulary)) for a, b in zip(edges[::2], edges[1::2])]
        ids.append(np.array(words, np.int64))
        lengths.append(len(words))
    use = np.flatnonzero(np.array(lengths) > 0)
    y = np.asarray(labels, float)[use]
    if not len(use) or y.min() == y.max():
        p = (np.sum(labels) + 1) / (len(labels) + 2)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))), window)
    word, n_words = np.concatenate([ids[i] for i in use]), len(vocabulary)
    last = np.cumsum([lengths[i] for i in use])
    first = last - np.array([lengths[i] for i in use])
    parts = word_parts(list(vocabulary))
    del vocabulary, ids
    size_of = np.concatenate([np.diff(starts) for _, starts in parts])
    used = np.flatnonzero(sum(np.bincount(b, minlength=BUCKETS) for b, _ in parts))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    parts = [(place[b], starts) for b, starts in parts]
    e = rng.normal(0, 0.1, (len(used), size)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, (size, 2)), 0.0
    state = [np.zeros_like(e), np.zeros_like(e), np.zeros_like(w), np.zeros_like(w), 0.0, 0.0]
    doc_of, counts = np.repeat(np.arange(len(use)), last - first), size_of[word]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for step in range(1, steps + 1):
        d = w[:, 1] - w[:, 0]
        each_bucket = e @ d
        sums = np.concatenate([np.add.reduceat(each_bucket[b], starts[:-1]) for b, starts in parts])[word]
        if step <= steps // 10:
            z = np.add.reduceat(sums, first) / np.maximum(1, np.add.reduceat(counts, first))
            begin, end = first, last
        else:
            z, begin = best_window(sums, counts, first, last, window)
            end = np.minimum(begin + window, last)
        delta = share * (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y)
        total = np.concatenate([[0], np.cumsum(counts)])
        per = np.zeros(len(word) + 1)
        each = delta / np.maximum(1, total[end] - total[begin])
        np.add.at(per, begin, each)
        np.add.at(per, end, -each)
        per_word, g, at = np.bincount(word, np.cumsum(per)[:-1], n_words), np.zeros(len(used)), 0
        for b, starts in parts:
            m = len(starts) - 1
            g += np.bincount(b, np.repeat(per_word[at:at + m], np.diff(starts)), len(used))
            at += m
        gw = e.T @ g
        grads = (np.outer(g, d).astype(np.float32), np.stack([-gw, gw], axis=1) + 1e-5 * w, delta.sum())
        new = []
        for i, (x, gr) in enumerate(zip((e, w, bias), grads, strict=True)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * gr
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * gr * gr
            new.append(x - rate * (state[2 * i] / (1 - 0.9 ** step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99 ** step)) + 1e-8))
        e, w, bias = new
    slope = np.zeros(BUCKETS, np.float32)
    slope[used] = e @ (w[:, 1] - w[:, 0])
    return ToxicityModel(slope, float(bias), window)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5,
                 most_each: int = 2_500, seed: int = 5, **how) -> ToxicityModel:
    """Learn from at most most_each texts of label 1 and as many of label 0, all from rows whose crc32(id) mod
    folds is not 0. Null ids and labels are left out; with one class or none, every text gets its share."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    rows = []
    for value in (1, 0):
        part, _ = labelled(docs, labels, "label", value, most_each, id_col="id", train=fold(F.col("id"), folds) != 0, seed=seed)
        rows += sorted((r["id"], r["text"] or "", value) for r in part.select("id", "text").collect())  # a bounded sample
    return train_bags([r[1] for r in rows], np.array([r[2] for r in rows], float), seed=seed, **how)
