"""Prefix trie of conversations: nodes from running hashes, subtree totals by bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import global_rank, running_totals
from tabloom.llm.common import written

#: Height of a band: nodes go to this many ancestors at most, and each round of bands covers this many times the depth of the last.
BAND = 8
#: Consecutive conversation numbers whose list is put together before the digest of a node runs over it.
CHUNK = 4096
PIECES = ("s1", "s2", "s3", "s4")


def conversation_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, r1, r2, bytes): turns numbered from 1 in the order of `turn_col`, nulls first; ties by a hash of role and text.

    r1 and r2 are 128 bits that stand for role and text, bytes the UTF-8 length of the text. Null role or text
    is empty; rows without a conversation are left out. A long conversation is ordered in many ranges.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).isNotNull().alias("timed"), F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("r1"), F.xxhash64(F.lit("second"), text, role).alias("r2"), F.octet_length(text).cast("long").alias("bytes"))
    return global_rank(written(turns), ["timed", "turn", "r1", "r2"], by=["conv"], rank="pos").select("conv", "pos", "r1", "r2", "bytes")


def with_shared_head(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first h turns of conversation c - c % group, h = crc32(c) % heads: (turns, lengths).

    turns (conv, depth, r1, r2, bytes, length) and lengths (conv, length) hold every conversation, turnless ones
    in `lengths` only. A conversation that isn't there gives no turns.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    sizes = written(turns.groupBy("conv").agg(F.count("*").alias("own")))
    base = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group).join(base, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    tail = turns.join(convs.select("conv", "h", "head", "length"), "conv").where("pos > h")
    tail = tail.withColumn("depth", F.col("pos") - F.col("h") + F.col("head"))
    first = turns.where((F.col("pos") < heads) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    shared = first.join(convs.select("conv", "base", "head", "length"), "base").where("pos <= head").withColumn("depth", F.col("pos"))
    columns = ["conv", "depth", "r1", "r2", "bytes", "length"]
    return tail.select(*columns).unionByName(shared.select(*columns)), convs.select("conv", "length")


def split_bits(x: Column) -> list[Column]:
    return [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]


def members(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows): distinct prefixes, and for each conversation and depth the node it passes.

    A prefix is known by the sum of hashes of its (depth, turn), 128 bits in four long sums, so that a long
    conversation's prefixes are running totals over many ranges. A node is named by (conv, depth), conv being
    its smallest member; this also names it in `rows` (conv, depth, node, length).
    """
    bits = [*split_bits(F.xxhash64("depth", "r1", "r2")), *split_bits(F.xxhash64("r2", "depth", "r1"))]
    sums = running_totals(written(turns), ["depth"], dict(zip(PIECES, bits, strict=True)), by=["conv"])
    rows = written(sums.select("conv", "depth", "bytes", "length", F.xxhash64(*PIECES).alias("k1"), F.xxhash64(F.lit("second"), *PIECES).alias("k2")))
    found = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum((F.col("length") > F.col("depth")).cast("long")).alias("longer"))
    found = written(found)
    root = written(lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("bytes"),
                               F.sum((F.col("length") > 0).cast("long")).alias("longer")).where("n_convs > 0"))
    zero = F.lit(0).cast("long").alias("depth")
    passed = rows.join(found.select("depth", "k1", "k2", "node"), ["depth", "k1", "k2"]).select("conv", "depth", "node", "length")
    top = lengths.select("conv", zero, F.lit((root.first() or [None])[0]).cast("long").alias("node"), "length")
    nodes = found.drop("k1", "k2").unionByName(root.select(zero, *root.columns))
    return written(nodes.withColumnRenamed("node", "conv")), written(passed.unionByName(top))


def band(depth: Column, level: int) -> Column:
    return F.floor(depth / F.lit(BAND ** (level + 1))).cast("long")


def subtree_totals(nodes: DataFrame, rows: DataFrame, height: int) -> DataFrame:
    """(conv, depth, weight, leaves): sums of `weight` and `leaf` over the subtree of each node, itself included.

    Nodes send their values to their ancestors within a band of BAND depths only. The totals of the band roots
    then do the same over bands of bands, BAND times as high, until one band holds all; from there the completed
    totals of band roots go down, each to the ancestors within the band above it. So there are two rounds for
    each power of BAND in the height, and each value goes to BAND ancestors at most in a round.
    """
    part, values = [], nodes.select("conv", "depth", "weight", "leaf")
    levels = 1
    while BAND ** levels <= height:
        levels += 1
    for k in range(levels):
        there = F.col("depth") % (BAND ** k) == 0
        held = rows.where(there).select("conv", "depth", "node").join(values.where(there), ["conv", "depth"], "left")
        chain = held.groupBy("conv", band(F.col("depth"), k).alias("band")).agg(
            F.collect_list(F.struct("depth", "node", "weight", "leaf")).alias("chain"), F.count("weight").alias("own")).where("own > 0")  # BAND entries at most
        below = lambda e, field: F.aggregate(
            F.filter("chain", lambda x: x["depth"] >= e["depth"]), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))
        sent = chain.select(F.explode(F.transform("chain", lambda e: F.struct(
            e["depth"].alias("depth"), e["node"].alias("conv"), below(e, "weight").alias("weight"), below(e, "leaf").alias("leaf")))).alias("s")).select("s.*")
        values = written(sent.groupBy("conv", "depth").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf")))
        part.append(values)
    whole = part[-1]
    for k in range(levels - 2, -1, -1):
        done = whole.where("depth > 0").select("conv", (band(F.col("depth"), k) - 1).alias("band"), "weight", "leaf")
        above = rows.where(F.col("depth") % (BAND ** k) == 0).select("conv", "depth", "node", band(F.col("depth"), k).alias("band"))
        more = above.join(done, ["conv", "band"]).select(F.col("node").alias("conv"), "depth", "weight", "leaf")
        whole = written(part[k].unionByName(more).groupBy("conv", "depth").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf")))
    return whole.withColumnRenamed("leaf", "leaves")


def end_digests(rows: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): digest of the ascending, comma-joined conversations that end at each node.

    Lists of CHUNK consecutive numbers are joined first; the digest then runs over a node's chunks in order, so
    no list is held whole.
    """
    ends = rows.where("depth = length").groupBy("node", "depth", F.floor(F.col("conv") / F.lit(CHUNK)).alias("chunk"))
    lists = ends.agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("listed"))
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for node, depth, listed in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "listed")), strict=True):
                if (node, depth) == now:
                    sha.update(b"," + listed.encode())
                else:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = (node, depth), hashlib.sha256(listed.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema[i].type) for i in range(3)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, sha.hexdigest())], schema=schema)

    dealt = lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk").select("node", "depth", "listed")
    return dealt.mapInArrow(digest, "conv long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv, depth, r1, r2, bytes, length) and (conv, length).

    conv is the smallest member, parent_conv that of the parent (null for the root); n_convs members, n_children
    children, n_leaves childless nodes of the subtree; saved_tokens sums (n_convs - 1) * bytes over the subtree;
    ends_sha256 names the members that end here. Equal conversations share all nodes and turnless ones are
    members of the root only. Without conversations there are no nodes.
    """
    nodes, rows = members(turns, lengths)
    nodes = written(nodes.select("conv", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight"), (F.col("longer") == 0).cast("long").alias("leaf")))
    height = nodes.agg(F.max("depth")).first()[0] or 0
    totals = subtree_totals(nodes, rows, height)
    up = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv"))
    edges = written(nodes.select("conv", "depth").join(up, ["conv", "depth"]))
    children = edges.groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    key = ["conv", "depth"]
    out = nodes.join(edges, key, "left").join(children, key, "left").join(totals.select(*key, "leaves", F.col("weight").alias("saved_tokens")), key)
    out = out.join(end_digests(rows), key, "left")
    return out.select("conv", "depth", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
                      "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
