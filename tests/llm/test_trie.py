"""The prefix trie of conversations against a walk over all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from tabloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int, node string"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    at = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            at[t[:d]].append(c)
    out = []
    for p, held in at.items():
        under = [q for q in at if q[:len(p)] == p]
        ends = sorted(c for c in held if len(whole[c]) == len(p))
        out.append((min(held), len(p), min(at[p[:-1]]) if p else None, len(held), sum(len(q) == len(p) + 1 for q in under),
                    sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in under) for q in under),
                    sum((len(at[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    turns, lengths = prefix_trie.with_shared_head(prefix_trie.conversation_turns(df))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, lengths).collect()), key=str)


def test_trie_agrees_with_all_prefixes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 24), 31, 33, 9000, 9001, 123456789012]:
        for turn in range(int(rng.integers(1, 12))):
            rows.append((c, turn, ["user", None, "assistant"][turn % 3], ["", None, "a", "é b", "long" * 9][int(rng.integers(0, 5))]))
    rows += [(c, turn, "user", f"t{turn}") for c in (50, 5000, 9105) for turn in range(90)]  # deeper than BAND ** 2
    rows += [(61, None, "user", "untimed"), (61, 3, "user", "last"), (61, -1, "user", "before"), (None, 1, "user", "lost"), (77, 1, "u", "x"), (77, 2, "u", "x")]
    df = spark.createDataFrame([(*r, "k", 1, None) for r in rows], SCHEMA)
    assert trie(df) == expected(rows)
    assert trie(df.repartition(7).select("text", "turn", "conv_id", "role", "node")) == expected(rows)


def test_trie_of_one_and_of_no_conversation(spark):
    one = [(4, 0, None, None, None, None, None)]
    assert trie(spark.createDataFrame(one, SCHEMA)) == expected(one)
    assert trie(spark.createDataFrame([], SCHEMA)) == []


def test_lists_of_many_members_are_digested_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    rows = [(c, 1, "u", "same") for c in range(0, 400, 3)]
    assert trie(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)) == expected(rows)
