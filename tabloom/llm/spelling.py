"""Spelling variants: words at edit distance 1 by search schemes over a bidirectional FM-index."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - for pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import small_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of vocabulary in one index; a half word with more of them around it is cut into several indexes.
INDEX_CHARS = 80_000
#: Queries that go through an index side by side, and bytes of a rank table beyond which it is kept in steps.
ABREAST, TABLE_BYTES = 2048, 64 << 20
#: Distinct words a task holds before it sends their counts on.
HELD = 200_000


# ---- vocabulary ------------------------------------------------------------------------------------------

def lowered(text: str | None) -> str:
    """A-Z in lower case and nothing else changed."""
    return (text or "").encode("utf-8", "replace").lower().decode("utf-8")


def noisy(run: str, prefix: int, rate: int) -> str:
    """The run, without one of its code points where `rate` divides its checksum (which goes on from `prefix`)."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % rate else run[:h % len(run)] + run[h % len(run) + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 5, min_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n): letter runs of whole texts, each counted over all documents.

    A run of which `noise` divides crc32("<id>:<run>") loses one code point first. Null texts have no runs, a null
    id stands for an empty one, repeated rows count again. Tasks add up what they read before the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in small_batches(batches, "text"):
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                prefix = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(RUN.findall(lowered(text))).items():
                    word = noisy(run, prefix, noise)
                    if len(word) >= min_chars:
                        found[word] += n
                if len(found) > HELD:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- index -----------------------------------------------------------------------------------------------

def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the text must end in a symbol that is nowhere else."""
    rank, width = text.astype(np.int64), 1
    while True:
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])[:len(rank)]
        key = rank * (len(rank) + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if rank[order[-1]] == len(text) - 1:
            return order
        width *= 2


class Ranks:
    """Of a Burrows-Wheeler transform: how many symbols below c stand before a row, for all c at once."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt, self.symbols, self.step = bwt, symbols, 1
        while len(bwt) // self.step * symbols * 4 > TABLE_BYTES:
            self.step *= 2
        n = len(bwt) // self.step + 1
        table = np.zeros((n + 1, symbols + 1), np.int32)
        np.add.at(table, (np.arange(len(bwt)) // self.step + 1, bwt.astype(np.int64) + 1), 1)
        self.table = table.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)

    def below(self, row: np.ndarray) -> np.ndarray:
        """(rows, symbols + 1): column c counts the symbols below c before the row."""
        out = self.table[row // self.step]
        for k in range(self.step - 1):
            inside = np.flatnonzero(k < row % self.step)
            at = self.bwt[row[inside] // self.step * self.step + k]
            out[inside] += at[:, None] < np.arange(self.symbols + 1)
        return out

    def one(self, row: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of symbols below c, and of c, before the row."""
        if self.step == 1:
            low = self.table[row, c]
            return low, self.table[row, c + 1] - low
        rows, at = self.below(row), np.arange(len(row))
        return rows[at, c], rows[at, c + 1] - rows[at, c]


class WordIndex:
    """Bidirectional FM-index of `#word#word#`: an interval of suffixes and one of reversed prefixes go together.

    Symbol 0 ends the text, 1 delimits words, the others are the code points that occur. A pattern is a triple
    (rows of it in the forward order, its first row in the backward order, number of rows) and grows to either side.
    """

    def __init__(self, words: list[str]):
        joined = "#" + "#".join(words) + "#"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet = np.setdiff1d(points, [ord("#")])
        self.symbols = len(self.alphabet) + 2
        text = np.append(self.numbers(points), 0)
        text[np.flatnonzero(points == ord("#"))] = 1
        self.begin = np.cumsum([1, *(len(w) + 1 for w in words)])[:-1]
        self.order = suffix_order(text)
        back = np.append(text[-2::-1], 0)
        self.sides = [Ranks(t[o - 1], self.symbols) for t, o in ((text, self.order), (back, suffix_order(back)))]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.size = len(text)

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; `symbols`, which no row has, for those not in the index."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, len(self.alphabet) + 2)

    def grown(self, side: int, here: np.ndarray, there: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns with c put on at the front (side 0) or the back (side 1); `here` is the interval of that side's order."""
        known = c < self.symbols
        c = np.where(known, c, 0)
        low, own = self.sides[side].one(here, c)
        low_end, own_end = self.sides[side].one(here + n, c)
        return self.first[c] + own, there + (low_end - low), np.where(known, own_end - own, 0)

    def every(self, side: int, here: np.ndarray, there: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pattern, symbol, here, there, n) of each letter that can be put on."""
        start, end = self.sides[side].below(here), self.sides[side].below(here + n)
        gap = end - start
        count = np.diff(gap, axis=1)
        count[:, :2] = 0  # no growth over the ends of words
        row, c = np.nonzero(count)
        return row, c, self.first[c] + (start[row, c + 1] - start[row, c]), there[row] + gap[row, c], count[row, c]

    def near(self, queries: list[str], half: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs at edit distance 1 that agree in the first (half 0) or last (half 1) half of the query.

        The agreeing half is matched and closed with a delimiter; then the other half is matched outwards with
        one error: a letter replaced, put in or left out, after which it must agree to the other delimiter.
        """
        pairs = [np.zeros((0, 2), np.int64)]
        order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
        for s in range(0, len(order), ABREAST):
            part = order[s:s + ABREAST]
            pairs.append(self.near_part([queries[i] for i in part], half) + [[0, 0]])
            pairs[-1][:, 0] = np.array(part, np.int64)[pairs[-1][:, 0]]
        q, w = np.unique(np.concatenate(pairs), axis=0).T
        return q, w

    def near_part(self, queries: list[str], half: int) -> np.ndarray:
        size = np.array([len(x) for x in queries])
        letters = np.full((len(queries), int(size.max()) + 1), self.symbols)
        for i, x in enumerate(queries):
            points = self.numbers(np.frombuffer(x.encode("utf-32-le"), np.uint32))
            letters[i, :len(x)] = points if half == 0 else points[::-1]  # read from the agreeing end
        fixed = size // 2 if half == 0 else size - size // 2
        inner, outer = (0, 1) if half == 0 else (1, 0)  # the side of the closing delimiter, and the one of the errors
        zero = np.zeros(len(queries), np.int64)
        here, there, n = zero, zero, zero + self.size
        for k in range(int(fixed.max()) - 1, -1, -1):
            now = k < fixed
            moved = self.grown(inner, here, there, n, letters[:, k])
            here, there, n = (np.where(now, a, b) for a, b in zip(moved, (here, there, n), strict=True))
        here, there, n = self.grown(inner, here, there, n, zero + 1)
        q = np.flatnonzero(n)
        exact = (q, fixed[q], there[q], here[q], n[q])  # here is now the order of the errors' side
        once = tuple(np.zeros(0, np.int64) for _ in range(5))
        found = []
        while len(exact[0]) or len(once[0]):
            q, at, here, there, n = exact
            row, c, h, t, m = self.every(outer, here, there, n)
            inside = at[row] < size[q[row]]
            other = inside & (c != letters[q[row], at[row]])
            new = [(q[row][other], at[row][other] + 1, h[other], t[other], m[other]), (q[row], at[row], h, t, m)]  # replaced, put in
            same = inside & ~other
            exact = (q[row][same], at[row][same] + 1, h[same], t[same], m[same])
            left = at < size[q]
            new.append((q[left], at[left] + 1, here[left], there[left], n[left]))  # left out
            q, at, here, there, n = (np.concatenate(x) for x in zip(once, *new, strict=True))
            done = at == size[q]
            _, end, m = self.grown(outer, here[done], there[done], n[done], np.ones(int(done.sum()), np.int64))
            front = end if outer else self.grown(outer, here[done], there[done], n[done], np.ones(int(done.sum()), np.int64))[0]
            word = np.searchsorted(self.begin, self.order[np.minimum(front, self.size - 1)] + 1, side="right") - 1
            found.append(np.stack([q[done], word], axis=1)[m > 0])
            q, at, here, there, n = (x[~done] for x in (q, at, here, there, n))
            here, there, n = self.grown(outer, here, there, n, letters[q, at])
            once = tuple(x[n > 0] for x in (q, at + 1, here, there, n))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


# ---- grouping --------------------------------------------------------------------------------------------

CELL = "shard long, block int, queries int, word string, n long, half int"
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("top_n", pa.int64()), ("top", pa.string())])


def half_key(half: int, word: Column, length: Column) -> Column:
    """The half that a word shares with queries of `length` letters which agree with it there."""
    first = F.floor(length / 2).cast("int")
    return F.concat(F.lit("<"), F.substring(word, F.lit(1), first)) if half == 0 else F.concat(F.lit(">"), F.right(word, length - first))


def cells(words: DataFrame) -> DataFrame:
    """Words (half null) and queries (half 0 or 1) by the index where they meet, each index of bounded size.

    A word stands under the halves that queries one letter shorter, as long and one longer would share with it;
    a query looks under its own two. Halves are packed into shards of INDEX_CHARS; a half with more is cut into
    blocks of words and blocks of queries, and each block of queries visits each block of words.
    """
    size = F.char_length("word")
    text = words.select("word", "n", F.explode(F.array_distinct(F.array(*[half_key(h, F.col("word"), size + d) for h in (0, 1) for d in (-1, 0, 1)]))).alias("key"))
    asked = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), half_key(h, F.col("word"), size).alias("key")) for h in (0, 1)])).alias("q"))
    asked = asked.select("word", "n", "q.key", "q.half")
    sizes = written(text.groupBy("key").agg(F.sum(F.char_length("word") + 1).alias("chars")))
    shards = 1 + (sizes.agg(F.sum("chars")).first()[0] or 0) // INDEX_CHARS
    large = written(sizes.where(F.col("chars") > INDEX_CHARS).select("key", F.ceil(F.col("chars") / INDEX_CHARS).cast("int").alias("cuts")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(large, "key", "left")
        every = F.when(F.col("cuts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
        place = F.when(F.col("cuts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
        shard = F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.xxhash64("key"))
        return rows.select(shard.alias("shard"), place.alias(own), "word", "n", "half", F.explode(every).alias(other))

    columns = [c.split()[0] for c in CELL.split(", ")]
    text = dealt(text.withColumn("half", F.lit(None).cast("int")), "block", "queries").select(*columns)
    return text.unionByName(dealt(asked, "queries", "block").select(*columns))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, top_n, top): how many words are at edit distance 1 of each, and the most frequent of them.

    Of equally frequent ones the smallest in code-point order counts. Words without near ones have no row. Each
    pair is found under the first half of the query, or else under the last.
    """

    def search(key, rows):
        half, word, n = (rows.column(c) for c in ("half", "word", "n"))
        held = dict(zip(*(x.filter(half.is_null()).to_pylist() for x in (word, n)), strict=True))
        listed = sorted(held)
        times, out = np.array([held[w] for w in listed], np.int64), []
        index = WordIndex(listed) if listed else None
        for side in (0, 1) if listed else ():
            asked = word.filter(pa.compute.equal(half, side)).to_pylist()
            if not asked:
                continue
            q, w = index.near(asked, side)
            if side:  # these came under the first half
                fresh = np.fromiter((listed[j][:len(asked[i]) // 2] != asked[i][:len(asked[i]) // 2] for i, j in zip(q.tolist(), w.tolist(), strict=True)), bool, len(q))
                q, w = q[fresh], w[fresh]
            order = np.lexsort((w, -times[w], q))
            first = np.flatnonzero(np.diff(q[order], prepend=-1))
            many = np.diff(np.append(first, len(order)))
            out += [(asked[q[i]], int(m), int(times[w[i]]), listed[w[i]]) for i, m in zip(order[first].tolist(), many, strict=True)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], FOUND[i].type) for i in range(4)], schema=FOUND)

    found = cells(words).groupBy("shard", "block", "queries").applyInArrow(search, "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("top"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("top_n"), "best.top")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain of forms; each round doubles the steps taken."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = after.select("word", "root")
        if not after.where("moved").head(1):
            return steps


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is `times` its own
    or more; the root ends the chain of forms, which has no cycle as n grows along it. An empty table has no rows.
    """
    words = written(words)
    near = words.join(near_words(words), "word", "left")
    near = written(near.withColumn("taken", F.coalesce(F.col("top_n") >= times * F.col("n"), F.lit(False))).select(
        "word", F.when(F.col("taken"), F.col("top")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), F.col("top_n")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
