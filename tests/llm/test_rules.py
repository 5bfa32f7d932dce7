"""Weak supervision of quality: counts against plain Python, expectation-maximisation against numpy."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import weak_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def some_texts():
    rng = np.random.default_rng(8)
    vocabulary = ["a", "b", "é", "the", "end.", "#x", "A|B", "so", "Öl", "***"]
    texts = [None, "", " ", "\n\n", "one", "a b c d", "a b c d e", "a a a a a a", "a a a a a a a", "x y z u v x y z u v", "x\ny\nx\n\nx \n x", "a\x0bb\x0cc\rd e f",
             "w " * 20_000, "\n".join(f"line {i % 7}" for i in range(300)), "&&&\n&&&\n&&& &&&"]
    return texts + [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) + "\n" * int(rng.integers(0, 3)) for _ in range(120)]


def test_counts_agree_with_plain_python(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in enumerate(texts)], "doc_id long, text string, w string, n_words int")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in weak_rules.features(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_rates_of_rules_are_learnt_without_labels(spark):
    """Votes of rules of known rates: the estimates come near them and the verdicts near the truth."""
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right_good, right_bad, votes_at = [0.95, 0.9, 0.97, 0.85, 0.99], [0.8, 0.7, 0.5, 0.9, 0.3], [1.0, 0.8, 0.6, 0.9, 0.7]
    rules = tuple(weak_rules.Rule(f"r{k}", "false", "false") for k in range(5))
    votes = np.stack([np.where(rng.random(len(good)) < v, np.where(good, np.where(rng.random(len(good)) < g, 1, -1), np.where(rng.random(len(good)) < b, -1, 1)), 0)
                      for g, b, v in zip(right_good, right_bad, votes_at, strict=True)], axis=1)
    patterns = Counter(map(tuple, votes.tolist()))
    df = spark.createDataFrame([(*p, n) for p, n in patterns.items()], ", ".join(f"r{k} int" for k in range(5)) + ", n long").cache()
    model = weak_rules.fit_rules(df, rules)
    assert abs(model.prior - 0.7) < 0.05
    assert np.allclose(model.on_good, right_good, atol=0.05) and np.allclose(model.on_bad, right_bad, atol=0.08)
    prior, on_good, on_bad = 0.8, np.full(5, 0.9), np.full(5, 0.4)  # the same rounds in numpy
    keys, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    for _ in range(weak_rules.ROUNDS):
        odds = np.log(prior / (1 - prior)) + np.where(keys == 1, np.log(on_good / (1 - on_bad)), np.where(keys == -1, np.log((1 - on_good) / on_bad), 0)).sum(1)
        p = 1 / (1 + np.exp(-odds))
        g, b = n * p, n * (1 - p)
        old = np.concatenate([[prior], on_good, on_bad])
        prior = (g.sum() + 2 * 0.8) / (n.sum() + 2)
        on_good = ((g[:, None] * (keys == 1)).sum(0) + 2 * 0.9) / ((g[:, None] * (keys != 0)).sum(0) + 2)
        on_bad = ((b[:, None] * (keys == -1)).sum(0) + 2 * 0.4) / ((b[:, None] * (keys != 0)).sum(0) + 2)
        if np.abs(np.concatenate([[prior], on_good, on_bad]) - old).max() < weak_rules.SETTLED:
            break
    assert np.allclose([model.prior, *model.on_good, *model.on_bad], [prior, *on_good, *on_bad])
    said = {r[:5]: r.p >= 0.5 for r in df.select("*", model.probability([F.col(r.name) for r in rules]).alias("p")).drop("n").collect()}
    assert np.mean([said[tuple(v)] == y for v, y in zip(votes.tolist(), good, strict=True)]) > 0.93


def test_verdicts_of_good_bad_and_odd_texts(spark, sf):
    from tabloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op12_quality_rules"](spark, sf)
    assert rows.count() == docs.count() and [t for _, t in rows.dtypes][1:6] == ["bigint"] * 5
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = rows.join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in both if r.quality == 1 and not r.base_failed]) > 0.98 and np.mean([r.kept for r in both if r.quality == 0]) < 0.2
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 50, 3)], "doc_id long, text string, length int")
    got = weak_rules.judge(odd).collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1 for r in got)
    assert weak_rules.judge(odd.where("false")).count() == 0
