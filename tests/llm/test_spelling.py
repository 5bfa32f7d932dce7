"""Spelling variants: the FM-index against all single edits, groups against a plain walk."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, half string"


def edits(word, letters):
    return ({word[:k] + word[k + 1:] for k in range(len(word))} | {word[:k] + c + word[k + 1:] for k in range(len(word)) for c in letters}
            | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}) - {word}


@pytest.mark.parametrize("table_bytes", [spelling.TABLE_BYTES, 2000])
def test_index_finds_all_words_one_edit_away(monkeypatch, table_bytes):
    monkeypatch.setattr(spelling, "TABLE_BYTES", table_bytes)
    monkeypatch.setattr(spelling, "ABREAST", 100)
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcé"), int(rng.integers(2, 9)))) for _ in range(700)} | {"a" * 300, "a" * 301})
    asked = [*words, "zzzzz", "abczb", "a" * 299]
    index, got = spelling.WordIndex(words), set()
    for half in (0, 1):
        q, w = index.near(asked, half)
        assert all(words[j].startswith(asked[i][:len(asked[i]) // 2]) if half == 0 else words[j].endswith(asked[i][len(asked[i]) // 2:]) for i, j in zip(q, w, strict=True))
        got |= {(asked[i], words[j]) for i, j in zip(q.tolist(), w.tolist(), strict=True)}
    assert got == {(a, b) for a in asked for b in edits(a, "abcé") & set(words)}


def expected(rows):
    counts = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in n for c in w})
    near = {w: edits(w, letters) & set(n) for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=str)


@pytest.mark.parametrize("index_chars", [spelling.INDEX_CHARS, 150])
def test_groups_agree_with_all_edits(spark, monkeypatch, index_chars):
    monkeypatch.setattr(spelling, "INDEX_CHARS", index_chars)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abÀü"), int(rng.integers(4, 8)))) for _ in range(90)]
    words += ["Colour", "colour", "color", "colours", "colou", "aaaaaa", "aaaaaaa", "aaaaa", "X" * 400, "x" * 399]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 80)), p=np.arange(len(words), 0, -1) / (len(words) * (len(words) + 1) / 2))) + "×\n1") for i in range(60)]
    rows += [(None, "colour, colour; colours"), (7, None), (8, ""), (8, "1 2 ß3"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(*r, "w", 1, None) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in spelling.spelling_groups(spelling.vocabulary(docs)).collect()), key=str)
    assert got == expected(rows) and any(r[1] for r in got)


def test_no_words_give_no_groups(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "short few", None, None, None)], SCHEMA)
    assert spelling.spelling_groups(spelling.vocabulary(docs)).count() == 0
    assert spelling.spelling_groups(spelling.vocabulary(docs.where("false"))).count() == 0
