"""SimHash near-duplicates: segment popcounts as a Manhattan lower bound, then exact bit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import dropped, free_name, small_batches, words_of, written
from tabloom.llm.components import star_components

SEED = 42
ODD = 0x5555555555555555
CHUNK = 65_536
CELL = 1_024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text; a bit is 1 if set in over half of the shingle hashes. No words: 0."""
    words = words_of(text)
    if not words:
        return 0
    n, total = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(start, min(n, start + CHUNK))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp) of every row; the hash tells apart rows that share an id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            fp = pa.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), fp], ["id", "text_hash", "fp"])

    return rows.mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: Column) -> Column:
    """The embedding: bit counts of the 32 two-bit segments, packed in unary (0, 1, 2 as 00, 01, 11).

    In this form the Manhattan distance of two embeddings is bit_count(x ^ y), and it never exceeds the
    bit distance of the fingerprints.
    """
    a, b = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grids(max_bits: int, spare: int) -> list[int]:
    """Masks of the segments that make a grid's cell: every choice of `spare` out of max_bits + spare blocks.

    Embeddings within Manhattan distance max_bits differ in at most max_bits blocks, so they share a cell in
    at least one grid.
    """
    blocks = np.array_split(np.arange(32), max_bits + spare)
    masks = [sum(3 << (2 * int(s)) for s in b) for b in blocks]
    return [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(len(blocks)), spare)]


def around(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, hub): every value within `radius` bits of each fingerprint, once. Position 64 stands for no flip."""
    out = fps.select("fp", F.col("fp").alias("hub"), F.lit(-1).alias("last"))
    for _ in range(radius):
        out = out.select("fp", "hub", F.explode(F.sequence(F.least(F.col("last") + 1, F.lit(64)), F.lit(64))).alias("last"))
        flip = F.when(F.col("last") < 64, F.expr("shiftleft(1L, last)")).otherwise(F.lit(0).cast("long"))
        out = out.select("fp", F.col("hub").bitwiseXOR(flip).alias("hub"), "last")
    return out.drop("last")


def link(fps: DataFrame, max_bits: int = 3, spare: int = 3, cell: int = CELL) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join up exactly those within max_bits, cell by cell.

    A cell of up to `cell` fingerprints is compared in one small array (Manhattan bound first, then bits) and
    gives one link per fingerprint at most. Larger cells take a way whose rows grow in proportion: a and b
    differ in at most max_bits iff some value lies within r1 bits of a and r2 = max_bits - r1 bits of b.
    """
    grid = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("e").bitwiseAND(F.lit(m)).alias("k"))
                     for i, m in enumerate(grids(max_bits, spare))])
    cells = fps.withColumn("e", popcounts(F.col("fp"))).select("fp", F.explode(grid).alias("g")).select("fp", "g.t", "g.k")
    shared = written(cells.groupBy("t", "k").count().where("count > 1"))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def forest(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            v = np.sort(np.asarray(g, np.int64)).view(np.uint64)
            x, y = v & np.uint64(ODD), (v >> np.uint64(1)) & np.uint64(ODD)
            e = (x | y) | ((x & y) << np.uint64(1))
            near = np.bitwise_count(e[:, None] ^ e[None, :]) <= max_bits
            i, j = np.nonzero(near)
            near[i, j] = np.bitwise_count(v[i] ^ v[j]) <= max_bits
            left, links, s = np.ones(len(v), bool), [], v.view(np.int64)
            for root in range(len(v)):
                if not left[root]:
                    continue
                left[root], front = False, np.array([root])
                while len(front):
                    front = np.flatnonzero(near[front].any(axis=0) & left)
                    left[front] = False
                    links += [{"a": int(s[root]), "b": int(s[f])} for f in front]
            out.append(links)
        return pd.Series(out)

    small = (cells.join(shared.where(F.col("count") <= cell).drop("count"), ["t", "k"])
             .groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
             .select(F.explode(forest("fps")).alias("l")).select("l.a", "l.b"))
    hot = cells.join(shared.where(F.col("count") > cell).drop("count"), ["t", "k"]).select("fp").distinct()
    r1 = max_bits // 2
    hubs = around(hot, r1).groupBy("hub").agg(F.min("fp").alias("a"))
    far = around(hot, max_bits - r1).join(hubs, "hub").select("a", F.col("fp").alias("b")).where("a <> b")
    links = written(small.unionByName(far).distinct())
    dropped(shared)
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3,
                       spare: int = 3, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, fp, component_id, kept) of every document, and the link table.

    component_id is the smallest id reachable over links of at most max_bits differing bits, the row itself
    included. kept marks one (id, text_hash) of each component: the smallest, null ids last.

    Null, empty and blank texts have fingerprint 0 and link like any other. Fewer words than a shingle count as
    one shingle. Repeated rows share their component. A null id never becomes a component id while the group
    has another; a group of null ids only has component_id null. An empty table gives no rows. Other columns,
    whatever their names, are not read. Exact copies meet as one fingerprint with its smallest id before any
    comparison, so a group of any size costs one row.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "text_hash")).alias("first")
    fps = written(rows.groupBy("fp").agg(first))
    links = link(fps.select("fp"), max_bits, spare, cell)
    roots = star_components(links)
    linked = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    named = written(linked.join(best, "root").select("fp", "best"))
    dropped(fps)
    kept = F.col("id").eqNullSafe(F.col("best.id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))
    out = rows.join(named, "fp").select("id", "text_hash", "fp", F.col("best.id").alias("component_id"), kept.alias("kept"))
    return out, links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without their near copies: one row of each component, with all its columns."""
    rows, _ = simhash_components(docs, id_col, text_col, **how)
    keep = rows.where("kept").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    mark = free_name(docs, "text_hash")
    tagged = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    on = tagged[id_col].eqNullSafe(keep["_id"]) & (tagged[mark] == keep["_hash"])
    return tagged.join(keep, on, "left_semi").dropDuplicates([id_col, mark]).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
