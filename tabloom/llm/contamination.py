"""Benchmark decontamination: rare n-grams of test items join documents, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import free_name, small_batches, written

WORD = re.compile(r"\w+")
MATCH, MISS, GAP = 2, -1, 1
#: Share of an item's n-grams, the most frequent ones in the documents, that fewer than this share are spared as seeds.
SPARED = 0.2
#: The filter of the items' n-grams has 16 bits for each, up to so many bits in all; beyond that it lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 28
SHARD_BITS = 1 << 19
PROBES = 3
#: Word hashes a task remembers.
HELD = 500_000


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and the end of the alignment in b (exclusive)."""
    best, end, step = 0, 0, GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        up = np.maximum(row[:-1] + np.where(b == w, MATCH, MISS), row[1:] - GAP)
        new = np.concatenate([[0], np.maximum(up, 0)])
        row = np.maximum.accumulate(new + step) - step  # gaps within the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grams:
    """64-bit codes of the n-grams of texts, from remembered word hashes."""

    def __init__(self, n: int):
        self.n, self.number, self.hash = n, {}, np.zeros(2 * HELD, np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        out = words_of(text)
        fresh = set(out).difference(self.number)
        if len(self.number) + len(fresh) > HELD:
            self.number, fresh = {}, set(out)
            self.hash = np.zeros(max(2 * HELD, len(fresh)), np.uint64)
        for w in fresh:
            self.number[w] = k = len(self.number)
            self.hash[k] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        return self.hash[np.fromiter(map(self.number.__getitem__, out), np.int64, len(out))]

    def of(self, words: np.ndarray) -> np.ndarray:
        m = len(words) - self.n + 1
        code = np.zeros(max(0, m), np.uint64)
        for k in range(self.n if m > 0 else 0):
            code = spread(code + words[k:k + m])
        return code


def bits_of(codes: np.ndarray, size: int) -> np.ndarray:
    """(codes, PROBES) places in a filter of `size` bits."""
    step = spread(codes) | np.uint64(1)
    return ((codes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


class Decontaminator:
    """Finds test items in texts, exact, edited or in part.

    Seeds are the n-grams of an item but for its most frequent ones in the documents: of g different n-grams fewer
    than SPARED * g are left out, so a copy that keeps this share of them, such as one with every fifth word
    replaced, still meets a seed, while an n-gram that stands in many documents and items joins nothing as long as
    the items have others. Documents are read once: a filter of bounded size passes on the n-grams that items may
    have, and Spark counts them, joins them with the seeds and groups the pairs. A pair is aligned over the part
    around its seeds, unless the words in common there are too few for any alignment to reach `least` of the score
    of an exact copy. Equal texts are aligned once. Neither items nor texts are gathered in the driver.

    Words are runs of letters, digits and underscore in lower case. Items of fewer than `n` words have no n-gram
    and are never found; null and empty items and texts likewise. Repeated items are reported each, repeated
    documents come out alike; empty tables give no matches; other columns are not read.
    """

    def __init__(self, items: DataFrame, grams: DataFrame, filter_bits: list[tuple[int, bytes]], size: int, n: int, least: float):
        self.items, self.grams, self.filter, self.size, self.n, self.least = items, grams, filter_bits, size, n, least
        self.seeds, self.docs, self.hits = None, None, None

    @classmethod
    def fit(cls, docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 4,
            least: float = 0.5) -> Decontaminator:
        """n-grams of the items, and which of them are seeds by the counts over all documents."""
        items = written(bench.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).select("item", "text", *text_keys(F.col("text"), "i")))
        texts = items.where("text is not null").groupBy("ia", "ib").agg(F.first("text").alias("text"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = Grams(n)
            for b in small_batches(batches, "text"):
                codes = [grams.of(grams.words(t)).view(np.int64) for t in b.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
                yield pa.RecordBatch.from_arrays([b.column("ia").take(row), b.column("ib").take(row), pa.array(np.concatenate([np.zeros(0, np.int64), *codes])),
                                                  pa.array(np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)]).astype(np.int32))],
                                                 ["ia", "ib", "gram", "at"])

        grams = written(texts.mapInArrow(cut, "ia long, ib long, gram long, at int"))
        size = int(min(MOST_BITS, max(1 << 12, 1 << int(BITS_EACH * grams.count()).bit_length())))

        def mark(key, rows):  # Arrow table; hints would have to be complete for Spark
            bits = np.zeros(min(size, SHARD_BITS), np.uint8)
            bits[rows.column("bit").to_numpy() % len(bits)] = 1
            return pa.table({"shard": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bits = np.unique(bits_of(b.column("gram").to_numpy().view(np.uint64), size))
                yield pa.RecordBatch.from_arrays([pa.array(bits // SHARD_BITS), pa.array(bits)], ["shard", "bit"])

        shards = grams.select("gram").distinct().mapInArrow(places, "shard long, bit long").distinct().groupBy("shard").applyInArrow(mark, "shard long, bits binary")
        out = cls(items, grams, [(r["shard"], bytes(r["bits"])) for r in shards.collect()], size, n, least)  # MOST_BITS at most
        out.docs, out.hits = (docs, text_col), out.touched(docs, text_col)
        held = out.hits.select("a", "b", F.explode(F.array_distinct("grams")).alias("gram"))
        df = written(held.join(grams.select("gram").distinct(), "gram", "semi").groupBy("gram").agg(F.count("*").alias("df")))
        present = grams.select("ia", "ib", "gram").distinct().join(df, "gram", "left")
        total = present.groupBy("ia", "ib").agg(F.count("*").alias("g"))
        listed = present.where("df is not null").groupBy("ia", "ib").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("less"), "gram"))).alias("all")).join(total, ["ia", "ib"])  # the n-grams of one item
        spared = F.ceil(F.col("g") * SPARED).cast("int") - 1
        chosen = listed.select("ia", "ib", F.explode(F.slice("all", spared + 1, F.size("all"))).alias("s"))
        out.seeds = written(chosen.select("ia", "ib", F.col("s.gram").alias("gram")).join(grams, ["ia", "ib", "gram"]))
        return out

    def touched(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(a, b, text, grams, places) of the different texts with n-grams that the filter passes on."""
        shards, size, n = docs.sparkSession.sparkContext.broadcast(self.filter), self.size, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, width = np.zeros(size // 8, np.uint8), min(size, SHARD_BITS) // 8
            for shard, part in shards.value:
                bits[shard * width:(shard + 1) * width] = np.frombuffer(part, np.uint8)
            grams = Grams(n)
            for b in small_batches(batches, "text"):
                rows, codes, places = [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    code = grams.of(grams.words(t))
                    at = bits_of(code, size)
                    ok = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)) if len(code) else at[:, 0]
                    if len(ok):
                        rows.append(i)
                        codes.append(code[ok].view(np.int64))
                        places.append(ok.astype(np.int32))
                part = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], [*b.schema.names, "grams", "places"])

        text = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").select(*text_keys(F.col("text"), ""), "text")
        found = text.mapInArrow(run, "a long, b long, text string, grams array<long>, places array<int>")
        return written(found.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("text", "grams", "places")]))

    def matches(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(a, b, ia, ib, score, start, end): different texts and items that align."""
        hits = self.hits if self.docs and self.docs[0] is docs and self.docs[1] == text_col else self.touched(docs, text_col)
        met = hits.select("a", "b", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("a", "b", F.col("h.grams").alias("gram"), F.col("h.places").alias("place"))
        pairs = met.join(self.seeds, "gram").groupBy("a", "b", "ia", "ib").agg(F.collect_set(F.col("place") - F.col("at")).alias("begins"))
        item_texts = self.items.groupBy("ia", "ib").agg(F.first("text").alias("item_text"))
        rows = written(pairs).join(item_texts, ["ia", "ib"]).join(hits.select("a", "b", "text"), ["a", "b"])
        least = self.least
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("ia", pa.int64()), ("ib", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, "text"):
                out = []
                for r in b.to_pylist():
                    found = aligned(words_of(r["item_text"]), words_of(r["text"]), r["begins"], least)
                    if found:
                        out.append((r["a"], r["b"], r["ia"], r["ib"], *found))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])

        return written(rows.mapInArrow(run, "a long, b long, ia long, ib long, score double, start int, end int"))

    def pairs(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, item, score, start, end) of every match; start and end are words of the document."""
        found = self.matches(docs, text_col).join(self.items.select("item", "ia", "ib"), ["ia", "ib"])
        rows = docs.select(F.col(id_col).alias("id"), *text_keys(F.col(text_col).cast("string"), ""))
        return rows.join(found, ["a", "b"]).select("id", "item", "score", "start", "end")

    def clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The documents in which no test item is found, as they are; null texts stay."""
        names = [free_name(docs, c) for c in ("a", "b")]
        found = self.matches(docs, text_col).select(F.col("a").alias(names[0]), F.col("b").alias(names[1])).distinct()
        keys = [k.alias(c) for k, c in zip(text_keys(F.col(text_col).cast("string"), ""), names, strict=True)]
        return docs.select("*", *keys).join(found, names, "anti").select(*docs.columns)


def text_keys(text: Column, prefix: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias(f"{prefix}a"), F.xxhash64(F.lit("second"), text).alias(f"{prefix}b")]


def aligned(item: list[str], text: list[str], begins: list[int], least: float) -> tuple[float, int, int] | None:
    """(share of an exact copy's score, first word, end) of the best alignment around the places where a copy may begin."""
    number: dict[str, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    words = np.array([number.get(w, -1) for w in text], np.int64)
    m, slack = len(a), len(a) // 2 + 8
    times, found, spans = np.bincount(a), (0, 0, 0), []
    for s in sorted(begins):
        lo, hi = max(0, s - slack), min(len(words), s + m + slack)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        part = words[lo:hi]
        there = np.bincount(part[part >= 0], minlength=len(times))
        if int(np.minimum(times, there).sum()) < least * m:
            continue  # even with all common words matched the score stays below
        score, end = local_alignment(a, part)
        if score > found[0]:
            found = (score, lo, lo + end)
    if found[0] < least * MATCH * m:
        return None
    _, back = local_alignment(a[::-1], words[found[1]:found[2]][::-1])
    return found[0] / (MATCH * m), found[2] - back, found[2]
