"""SimHash and embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import embeddings, simhash
from tabloom.llm.components import star_components


def components(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def bits(fp):
    return fp & (1 << 64) - 1


def check_simhash(rows, got):
    """rows: (id, text); got: rows of simhash_components."""
    fps = {(r["id"], r["text_hash"]): r for r in got}
    assert len(got) == len(rows)
    items = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    fp = [bits(simhash.fingerprint(t)) for _, t in items]
    root = components(len(items), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    want = sorted((str(items[i][0]), fp[i], str(items[root[i]][0])) for i in range(len(items)))
    assert want == sorted((str(r["id"]), bits(r["fp"]), str(r["component_id"])) for r in got)
    assert len({k for k, r in fps.items() if r["kept"]}) == len(set(root))


@pytest.mark.parametrize("cell", [simhash.CELL, 1])
def test_simhash_matches_brute_force(spark, sf, cell):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows, _ = simhash.simhash_components(docs, cell=cell)
    check_simhash([(r.doc_id, r.text) for r in docs.collect()], rows.collect())


@pytest.mark.parametrize("cell", [simhash.CELL, 2])
def test_links_join_up_all_near_fingerprints(spark, cell):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 20)
    fps = sorted({int(b) ^ simhash.signed(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False))) for b in base for _ in range(12)})
    links = simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long"), cell=cell).collect()
    assert links
    root = components(len(fps), lambda i, j: (bits(fps[i]) ^ bits(fps[j])).bit_count() <= 3)
    at = {f: i for i, f in enumerate(fps)}
    pairs = {frozenset((at[r["a"]], at[r["b"]])) for r in links}
    assert components(len(fps), lambda i, j: frozenset((i, j)) in pairs) == root


def test_popcounts_bound_the_bit_distance(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(-(1 << 63), 1 << 63, (2, 200))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "a long, b long")
    r = df.select(F.bit_count(simhash.popcounts(F.col("a")).bitwiseXOR(simhash.popcounts(F.col("b")))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"), "a", "b").collect()
    for row in r:
        count = lambda v, s: (bits(v) >> 2 * s & 3).bit_count()
        assert row["m"] == sum(abs(count(row["a"], s) - count(row["b"], s)) for s in range(32)) <= row["d"]


def test_simhash_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (None, "one"), (6, "two words"), (7, "a b c d e " * 50_000), (7, "a b c d e " * 50_000), (None, "alone here now")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got, _ = simhash.simhash_components(docs)
    check_simhash(rows, got.collect())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == [("1", ""), ("4", "one"), ("6", "two w"), ("7", "a b c"), ("None", "alone")]
    assert simhash.simhash_components(docs.where("false"))[0].count() == 0
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in star_components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def brute_vectors(rows, least=0.95):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in fine}
    near = lambda i, j: i in unit and j in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    return near, components(len(rows), near)


@pytest.mark.parametrize("block", [embeddings.BLOCK, 8])
def test_embeddings_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=32)
        rows += [(centre + rng.normal(size=32) * 0.12).tolist() for _ in range(int(rng.integers(1, 40)))]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(i + 10_000, rows[0][1]) for i in range(30)]  # copies
    got = {r["id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
    near, root = brute_vectors(rows)
    want = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    have = [got[i]["n_links"] for i, _ in rows]
    assert all(h <= w for h, w in zip(have, want)) and sum(have) >= 0.97 * sum(want)
    assert [got[i]["component_id"] for i, _ in rows] == [rows[root[k]][0] for k in range(len(rows))]


def test_embeddings_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]),
            (None, [1.0, 2.0]), (10, [1e200, 2e200]), (11, [-1.0, 3.0]), (11, [-1.0, 3.0])]
    docs = spark.createDataFrame([(i, v, "t", 0.5) for i, v in rows], "vec_id long, embedding array<double>, t string, key double")
    got = sorted((str(r["id"]), r["n_links"], str(r["component_id"])) for r in embeddings.near_vectors(docs).collect())
    none = [(str(i), 0, str(i)) for i in (1, 2, 3, 4, 5, 6, 9)]
    linked = [(str(i), 3, "7") for i in (7, 8, None, 10)]
    assert got == sorted(none + linked + [("11", 1, "11")] * 2)
    assert embeddings.near_vectors(docs.where("false")).count() == 0
