"""Reversible line dedup: exact reference counts per line, with a sharded cuckoo filter in front."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SLICE, dropped, free_name, small_batches, written

SLOTS, KICKS, FULL = 4, 200, 0.9
SHARD_KEYS = 1 << 16
#: Filters travel to the tasks up to this many bytes, and so do exact exceptions; beyond it lines go to an exact join.
SENT_BYTES = 32 << 20
#: Keys in most documents that the exact join leaves to the tasks that read the lines, so that none is hot there.
HOT_KEYS = 1 << 14
#: Insertions and deletions kept side by side before their counts are merged.
PARTS = 8
STRIPPED = " \t\n\x0b\x0c\r"


# ---- cuckoo filter ---------------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that bucket and tag use independent bits."""
    x = np.asarray(x).astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turns(x: np.ndarray) -> np.ndarray:
    """How often each value came before in the array."""
    order = np.argsort(x, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]])) if len(x) else np.zeros(0, np.int64)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x))))
    return out


class Cuckoo:
    """Cuckoo filter with 32-bit tags, four slots a bucket, and a stash of (bucket, tag) for what found no place.

    It has no false negatives for keys that were added as often as they were taken out. Keys are placed in
    rounds over whole arrays. Its size is fixed: a filter that is `full` is made anew from the exact table.
    """

    def __init__(self, slots: np.ndarray, stash: list[tuple[int, int]]):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))), SLOTS), np.uint32), [])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(keys)
        tag, a = np.maximum(h >> np.uint64(32), np.uint64(1)), (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return tag.astype(np.uint32), a, self.other(a, tag)

    def other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(tag) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def put(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Fill free slots; returns which of the tags found none."""
        free, turn = self.slots[bucket] == 0, turns(bucket)
        ok = turn < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (turn + 1)[:, None]).argmax(axis=1)
        self.slots[bucket[ok], slot[ok]] = tag[ok]
        return ~ok

    def add(self, keys: np.ndarray) -> None:
        tag, a, b = self.places(keys)
        left = self.put(a, tag)
        tag, b = tag[left], b[left]
        left = self.put(b, tag)
        tag, at = tag[left], b[left]
        for step in range(KICKS):
            if not len(tag):
                return
            first = turns(at) == 0  # one tag is thrown out of a bucket at a time
            row, slot = at[first], (step + tag[first].astype(np.int64)) % SLOTS
            out = self.slots[row, slot]
            self.slots[row, slot] = tag[first]
            tag, at = np.concatenate([out, tag[~first]]), np.concatenate([self.other(row, out), at[~first]])
            left = self.put(at, tag)
            tag, at = tag[left], at[left]
        self.stash += zip(np.minimum(at, self.other(at, tag)).tolist(), tag.tolist(), strict=True)

    def remove(self, keys: np.ndarray) -> None:
        """Take out one entry for each key that has one."""
        tag, a, b = self.places(keys)
        turn = turns(np.minimum(a, b) << 32 | tag.astype(np.int64))
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            now, x, y = tag[turn == t], a[turn == t], b[turn == t]
            for _ in range(2):
                same = self.slots[x] == now[:, None]
                hit = same.any(axis=1)
                self.slots[x[hit], same.argmax(axis=1)[hit]] = 0
                now, x, y = now[~hit], y[~hit], x[~hit]
            out = Counter(zip(np.minimum(x, y).tolist(), now.tolist(), strict=True)) if self.stash else Counter()
            self.stash = list((Counter(self.stash) - out).elements()) if out else self.stash

    def holds(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(keys)
        found = (self.slots[a] == tag[:, None]).any(axis=1) | (self.slots[b] == tag[:, None]).any(axis=1)
        if self.stash:
            found |= np.isin(np.minimum(a, b) << 32 | tag.astype(np.int64), [k << 32 | g for k, g in self.stash])
        return found


# ---- lines of texts --------------------------------------------------------------------------------------

def line_hash(key: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(key, seed)
    return h - (1 << 64) if h >> 63 else h


SECOND = xxhash.xxh64_intdigest(b"second", 42)


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line in UTF-8, None for lines of fewer than min_chars code points (blank ones always)."""
    keys = [x.strip(STRIPPED) for x in (text or "").split("\n")]
    return [k.encode("utf-8", "replace").lower() if k and len(k) >= min_chars else None for k in keys]


KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64())])


def key_batch(keys: list[bytes]) -> pa.RecordBatch:
    """128 bits of each key; equal keys, and in practice only these, agree in both."""
    return pa.RecordBatch.from_arrays([pa.array([line_hash(k, s) for k in keys], pa.int64()) for s in (42, SECOND)], schema=KEYS)


def text_keys(docs: DataFrame, text_col: str, chosen: Callable[[list], list[bytes]]) -> DataFrame:
    """(k1, k2) of the lines that `chosen` picks from the texts of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            for s in range(0, b.num_rows, SLICE):
                yield key_batch(chosen(b.column("text").slice(s, SLICE).to_pylist()))

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "k1 long, k2 long")


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(k1, k2, n_docs): documents that hold each line key of at least min_chars code points, each document once."""
    held = text_keys(docs, text_col, lambda texts: [k for t in texts for k in set(line_keys(t, min_chars)) if k is not None])
    return held.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"))


# ---- index -----------------------------------------------------------------------------------------------

FILTER = "shard long, keys long, slots binary, stash array<long>"
FILTER_ARROW = pa.schema([("shard", pa.int64()), ("keys", pa.int64()), ("slots", pa.binary()), ("stash", pa.list_(pa.int64()))])


def to_row(shard: int, keys: int, f: Cuckoo) -> pa.Table:
    return pa.Table.from_pydict({"shard": [shard], "keys": [keys], "slots": [f.slots.tobytes()], "stash": [[x for pair in f.stash for x in pair]]}, schema=FILTER_ARROW)


def from_row(slots: bytes, stash) -> Cuckoo:
    return Cuckoo(np.frombuffer(bytes(slots), np.uint32).reshape(-1, SLOTS).copy(), [(int(k), int(g)) for k, g in zip(stash[::2], stash[1::2], strict=True)])


def made(keys: DataFrame) -> DataFrame:
    """A filter for each shard of (shard, k1)."""

    def fill(key, rows):  # hints would have to be complete for Spark
        f = Cuckoo.sized(rows.num_rows)
        f.add(rows.column("k1").to_numpy())
        return to_row(key[0].as_py(), rows.num_rows, f)

    return keys.select("shard", "k1").groupBy("shard").applyInArrow(fill, FILTER)


class Filters:
    """The filters of all shards as a task holds them."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards, self.of = shards, {s: from_row(*x) for s, *x in rows}

    def holds(self, k1: np.ndarray) -> np.ndarray:
        shard, out = np.mod(k1, self.shards), np.zeros(len(k1), bool)
        for s in np.unique(shard):
            if s in self.of:
                out[shard == s] = self.of[s].holds(k1[shard == s])
        return out

    def passed(self, texts: list[str | None], min_chars: int) -> list[dict[int, tuple[bytes, int]]]:
        """Of each text, position -> (key, k1) of the lines that the filters can't rule out."""
        keys = [line_keys(t, min_chars) for t in texts]
        at = [(i, p, k) for i, ks in enumerate(keys) for p, k in enumerate(ks) if k is not None]
        k1 = np.fromiter((line_hash(k) for _, _, k in at), np.int64, len(at))
        out: list[dict] = [{} for _ in texts]
        for j in np.flatnonzero(self.holds(k1)).tolist():
            i, p, k = at[j]
            out[i][p] = (k, int(k1[j]))
        return out


class LineIndex:
    """Which lines occur in how many documents, kept under insertions and deletions of documents.

    `refs` (k1, k2, n_docs) is exact and decides. Its rows are sums over `parts`, one written table for each
    change, merged when there are more than PARTS of them; counts are signed, so a deletion of documents that
    were never inserted leaves a debt which a later insertion pays, and every order of changes gives the same
    counts. `filters` holds, per shard of the key space, a cuckoo filter of the keys found in at least
    `min_docs` documents. A shard beyond FULL of its slots is filled anew at its new size from the exact table,
    and all shards are dealt anew once they hold twice SHARD_KEYS on average. All are tables in the shared folder.
    """

    def __init__(self, parts: list[DataFrame], filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.parts, self.filters, self.shards, self.min_docs, self.min_chars = parts, filters, shards, min_docs, min_chars

    @property
    def refs(self) -> DataFrame:
        if len(self.parts) == 1:
            return self.parts[0]
        every = reduce(DataFrame.unionByName, self.parts)
        return every.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")

    @property
    def common(self) -> DataFrame:
        return self.refs.where(F.col("n_docs") >= self.min_docs)

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        """Index of a table; an empty table gives an index without keys."""
        return cls.of([written(line_counts(docs, text_col, min_chars))], min_docs, min_chars)

    @classmethod
    def of(cls, parts: list[DataFrame], min_docs: int, min_chars: int) -> LineIndex:
        bare = cls(parts, None, 1, min_docs, min_chars)
        bare.shards = 1 + bare.common.count() // SHARD_KEYS
        bare.filters = written(made(bare.sharded(bare.common)))
        return bare

    def sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("k1", F.lit(self.shards)))

    def changed(self, docs: DataFrame, sign: int, text_col: str) -> LineIndex:
        by = written(line_counts(docs, text_col, self.min_chars).withColumn("n_docs", F.col("n_docs") * sign))
        touched = by.select("k1", "k2", F.col("n_docs").alias("by"))
        was = reduce(DataFrame.unionByName, self.parts).join(touched.select("k1", "k2"), ["k1", "k2"], "semi")
        was = was.groupBy("k1", "k2").agg(F.sum("n_docs").alias("was"))
        both = touched.join(was, ["k1", "k2"], "left").select("k1", F.coalesce("was", F.lit(0)).alias("was"), "by")
        low = self.min_docs
        turned = written(self.sharded(both.where((F.col("was") >= low) != (F.col("was") + F.col("by") >= low))
                                      .select("k1", (F.col("was") + F.col("by") >= low).alias("add"))))
        parts = [*self.parts, by]
        if len(parts) > PARTS:
            parts = [written(LineIndex(parts, self.filters, self.shards, low, self.min_chars).refs)]
        grown = turned.groupBy("shard").agg(F.sum(F.when(F.col("add"), 1).otherwise(-1)).alias("more"))
        sizes = self.filters.select("shard", "keys", (F.octet_length("slots") / 4).alias("slots")).join(grown, "shard", "full")
        sizes = written(sizes.select("shard", (F.coalesce("keys", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("now"), F.coalesce("slots", F.lit(0)).alias("slots")))
        if (sizes.agg(F.sum("now")).first()[0] or 0) > 2 * SHARD_KEYS * self.shards:
            return LineIndex.of(parts, low, self.min_chars)

        def update(key, old, rows):
            f, add = from_row(old.column("slots")[0].as_py(), old.column("stash")[0].as_py()), rows.column("add").to_numpy()
            f.remove(rows.column("k1").to_numpy()[~add])
            f.add(rows.column("k1").to_numpy()[add])
            return to_row(key[0].as_py(), old.column("keys")[0].as_py() + int(add.sum()) - int((~add).sum()), f)

        after = LineIndex(parts, self.filters, self.shards, low, self.min_chars)
        full = sizes.where(F.col("now") > FULL * F.col("slots")).select("shard")
        stays = self.filters.join(full, "shard", "anti")
        same = stays.join(turned.select("shard").distinct(), "shard", "anti")
        edit = stays.join(turned.select("shard").distinct(), "shard", "semi")
        moved = turned.join(full, "shard", "anti")
        fresh = made(after.sharded(after.common).join(full, "shard", "semi"))
        edited = edit.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, FILTER)
        after.filters = written(same.select(*FILTER_ARROW.names).unionByName(edited).unionByName(fresh))
        dropped(turned, sizes)
        return after

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index after these documents have been added."""
        return self.changed(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index after these documents have been taken out; it equals one that never held them."""
        return self.changed(docs, -1, text_col)

    def sent(self, docs: DataFrame) -> Broadcast | None:
        """The filters for the tasks, if they are within SENT_BYTES."""
        total = self.filters.agg(F.coalesce(F.sum(F.octet_length("slots") + 8 * F.size("stash")), F.lit(0))).first()[0]
        if total > SENT_BYTES:
            return None
        return docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["slots"]), r["stash"]) for r in self.filters.collect()])

    def exceptions(self, docs: DataFrame, text_col: str, filters: Broadcast) -> set[tuple[int, int]] | None:
        """Keys of the texts that pass the filters and are not common, None if they exceed SENT_BYTES."""
        shards, low = self.shards, self.min_chars

        def passed(texts: list) -> list[bytes]:
            held = Filters(filters.value, shards) if not memo else memo[0]
            memo[:] = [held]
            return list({k for p in held.passed(texts, low) for k, _ in p.values()})

        memo: list[Filters] = []
        false = text_keys(docs, text_col, passed).distinct().join(self.common, ["k1", "k2"], "anti")
        some = false.limit(SENT_BYTES // 64 + 1).collect()  # bounded; the exact join takes over beyond
        return None if len(some) > SENT_BYTES // 64 else {tuple(r) for r in some}

    def clean(self, docs: DataFrame, text_col: str = "text", *, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
        """The documents without their common lines, in place of `text_col`; two counts are added.

        A null or empty text is one empty line and stays as it is. Blank lines have no key and stay. Repeated
        rows count as documents of their own and come out alike. Texts that lose all lines become empty. Other
        columns pass through, also when named like the columns used inside.

        Where the filters are small enough to be sent, tasks drop each line that passes them and is no exception;
        exceptions are the few keys that pass wrongly, found beforehand against the exact table. No text is
        shuffled, so copies and frequent lines cost nothing extra. Beyond that, `clean_by_join` decides.
        """
        filters = self.sent(docs)
        false = None if filters is None else self.exceptions(docs, text_col, filters)
        if false is None:
            return self.clean_by_join(docs, text_col, lines_col, dropped_col)
        wrong, shards, low = docs.sparkSession.sparkContext.broadcast(false), self.shards, self.min_chars
        firsts = docs.sparkSession.sparkContext.broadcast({k for k, _ in false})

        def cleaned(texts: list, held: Filters) -> list[dict]:
            out = []
            for t, passed in zip(texts, held.passed(texts, low), strict=True):
                gone = {p for p, (k, k1) in passed.items() if k1 not in firsts.value or (k1, line_hash(k, SECOND)) not in wrong.value}
                lines = (t or "").split("\n")
                text = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
                out.append({"t": text, "n": len(lines), "d": len(gone)})
            return out

        return replaced(docs, text_col, lines_col, dropped_col, [F.col(text_col).cast("string")], lambda: Filters(filters.value, shards), cleaned)

    def clean_by_join(self, docs: DataFrame, text_col: str, lines_col: str, dropped_col: str) -> DataFrame:
        """As `clean`, by an exact join of the lines' keys. Equal texts send their lines once from each task and
        once overall; the HOT_KEYS keys of most documents are decided where the lines are read."""
        low = self.min_chars
        hot = {(r["k1"], r["k2"]) for r in self.common.orderBy(F.desc("n_docs"), "k1", "k2").limit(HOT_KEYS).collect()}
        hot = docs.sparkSession.sparkContext.broadcast(hot)
        a_col, b_col, gone_col = (free_name(docs, c) for c in ("text_a", "text_b", "text_gone"))
        names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("hot", pa.bool_())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, "text"):
                rows, seen = [], set()
                for t in b.column("text").to_pylist():
                    whole = (t or "").encode("utf-8", "replace")
                    a = (line_hash(whole), line_hash(whole, SECOND))
                    if a in seen:
                        continue
                    seen.add(a)
                    rows += [(*a, p, line_hash(k), line_hash(k, SECOND)) for p, k in enumerate(line_keys(t, low)) if k is not None]
                rows = [(*r, (r[3], r[4]) in hot.value) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], names[i].type) for i in range(6)], schema=names)

        lines = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(
            run, "a long, b long, pos int, k1 long, k2 long, hot boolean")
        lines = written(lines)
        rest = lines.where("not hot").join(self.common.select("k1", "k2"), ["k1", "k2"], "semi")
        gone = written(lines.where("hot").unionByName(rest.select(*lines.columns)).groupBy("a", "b").agg(F.collect_set("pos").alias("gone")))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        tagged = docs.select("*", F.xxhash64(text).alias(a_col), F.xxhash64(F.lit("second"), text).alias(b_col))
        both = tagged.join(gone.select(F.col("a").alias(a_col), F.col("b").alias(b_col), F.col("gone").alias(gone_col)), [a_col, b_col], "left")

        def cleaned(texts: list, positions: list) -> list[dict]:
            out = []
            for t, gone in zip(texts, positions, strict=True):
                lines, gone = (t or "").split("\n"), set(gone or ())
                out.append({"t": "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t, "n": len(lines), "d": len(gone)})
            return out

        out = replaced(both, text_col, lines_col, dropped_col, [F.col(text_col).cast("string"), F.col(gone_col)], None, cleaned)
        return out.drop(a_col, b_col, gone_col)


RESULT = pa.struct([("t", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def replaced(docs: DataFrame, text_col: str, lines_col: str, dropped_col: str, inputs: list[Column], state, cleaned) -> DataFrame:
    """docs with a new text and two counts, made slice by slice from Arrow columns."""

    def parts(batch: tuple, held) -> pa.Array:
        made = [pa.array(cleaned(*[c.slice(s, SLICE).to_pylist() for c in batch], *held), RESULT) for s in range(0, len(batch[0]), SLICE)]
        return pa.concat_arrays(made) if made else pa.array([], RESULT)

    if len(inputs) == 1:

        @F.arrow_udf("t string, n long, d long")
        def one(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = [state()] if state else []
            for b in texts:
                yield parts((b,), held)

        new = one(*inputs)
    else:

        @F.arrow_udf("t string, n long, d long")
        def two(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for b in texts:
                yield parts(b, [])

        new = two(*inputs)
    col = free_name(docs, "cleaned")
    rows = docs.withColumn(col, new)
    return rows.select(*[F.col(f"{col}.t").alias(c) if c == text_col else rows[c] for c in docs.columns],
                       F.col(f"{col}.n").alias(lines_col), F.col(f"{col}.d").alias(dropped_col))
