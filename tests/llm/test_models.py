"""Held-out accuracy and edge cases of the trained models, the queries against brute force, and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tabloom.llm import quality, toxicity
from tabloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize("name, column, low", [("op5_toxicity", "toxic", 0.94), ("op10_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, column, low):
    rows = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [(r["doc_id"], r[column]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(rows[i]["score"], rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    score, predicted, y = map(np.array, zip(*held))
    assert area(score, y) > low and (predicted == y).mean() > 0.94
    guess = max(y.mean(), 1 - y.mean())
    assert (predicted == y).mean() > guess


def test_misspellings_share_grams():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("aeionrst"), 6))
    texts = [" ".join(word() for _ in range(40)) for _ in range(400)]
    bad = ["dreadfulness", "abominable"]
    y = np.array([i % 2 for i in range(400)])
    texts = [t + " " + bad[i % 4 // 2] + " " + word() if y[i] else t for i, t in enumerate(texts)]
    model = toxicity.train_bags(texts, y)
    assert model.logit("nest roast dreadfullnes tiara") > 0 > model.logit("nest roast tiara stone")
    assert model.logit("x " * 400_000 + "dreadfulness") > 0
    assert model.logit(None) == model.logit("") == model.logit("!! ??") == pytest.approx(model.bias)


def test_sub_words_are_those_of_single_words():
    text = "Der Weg, è +1-a\n日本 x"
    bucket, owner = toxicity.subwords(toxicity.code_points(text))
    for k, w in enumerate(["der", "weg", "è", "1", "a", "日本", "x"]):
        assert sorted(bucket[owner == k]) == sorted(toxicity.subwords(toxicity.code_points(w))[0])


def test_models_without_rows_or_classes(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1), (2, None, 0.2), (2, "", 0.3), (None, "c", 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        q, t = quality.fit_quality(docs, lab), toxicity.fit_toxicity(docs, lab)
        for m in (q, t):
            got = [r[0] for r in docs.select(m.score(docs["text"])).collect()]
            assert len(got) == 4 and all(0 <= s <= 1 for s in got)
            assert docs.where("false").select(m.score(docs["text"])).count() == 0
    assert quality.features("x" * 3_000_000)[quality.LOW] == pytest.approx(np.log1p(1000))


def test_non_negative_risk_ranks_without_negatives():
    rng = np.random.default_rng(10)
    good, bad = rng.normal(1, 1, (3000, 5)), rng.normal(-1, 1, (3000, 5))
    model = quality.train_pu(good[:500].astype(np.float32), np.concatenate([good[500:2000], bad[:1500]]).astype(np.float32), 0.5)
    x, y = np.concatenate([good[2000:], bad[1500:]]), np.array([1] * 1000 + [0] * 1500)
    assert area(model.scores(x), y) > 0.98 and ((model.scores(x) >= 0.5) == y).mean() > 0.93


def test_pipeline_stages(spark, sf):
    """Each stage keeps the columns and removes what brute force on its own input removes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = out.collect()
        seen[name] = len(after)
        if name != "mix":
            assert out.columns == docs.columns and {r.doc_id for r in after} <= set(before)
            assert len({r.doc_id for r in after}) == len(after)
        if name != "lines":
            assert all(r.text == before[r.doc_id].text for r in after)
        if name == "lines":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id].text)
        if name == "benchmark":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            gone = {i for i, r in before.items() if any(t in r.text for t in items)}
            assert gone <= set(before) - {r.doc_id for r in after} and len(after) >= 0.8 * len(before)
        if name == "near_copies":
            from tabloom.llm.simhash import fingerprint
            fp = [fingerprint(r.text) & (1 << 64) - 1 for r in after]
            assert all((fp[i] ^ fp[j]).bit_count() > 3 for i in range(len(fp)) for j in range(i))
        docs = spark.createDataFrame(after, out.schema)
    assert seen["mix"] > 0


def test_pipeline_stages_take_odd_rows(spark, sf):
    text = "a common line of text\nand something own "
    rows = [(i, text + str(i), "en", None, 5) for i in range(12)] + [(None, None, None, None, None), (3, "", "en", "s", 0), (3, text + "3", "en", None, 5), (90, "w " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, epoch int, text_hash int, n_lines string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        empty = stage(spark, docs.where("false"), sf)
        assert empty.count() == 0 and empty.columns == out.columns
        assert out.columns[:len(docs.columns)] == docs.columns
        assert out.count() >= 1, name
