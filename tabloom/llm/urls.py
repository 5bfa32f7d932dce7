"""URL filters: all glob rules as one bit-parallel automaton over canonical URLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY, ONE, HOST = object(), object(), object()  # *: any run; ?: one character; a run inside the host
ROWS = 4_096


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and all its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list]:
        tail = [*(self.host + self.path).encode(), ANY]
        return [tail, [HOST, ord("."), *tail]]


@dataclass(frozen=True)
class Glob:
    """A verdict for canonical URLs (host and path) that match a pattern of characters, * and ?."""

    verdict: str
    pattern: str

    def globs(self) -> list[list]:
        return [[x for ch in self.pattern for x in ([ANY] if ch == "*" else [ONE] if ch == "?" else ch.encode())]]


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): host in lower case (A-Z), both empty for null or without "://"."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate(LOWER), rest[:stop]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Automaton:
    """Shift-And over as many 64-bit words as the patterns need.

    A pattern takes one start bit and one bit per character; wildcards are loops on the bit before them. For a
    byte c the bits go on by D = (D << 1) & enter[c] | D & stay[c], carried across words, for all patterns and a
    whole batch of URLs at once.
    """

    def __init__(self, patterns: Sequence[tuple[int, list]]):
        """patterns: (rule number, elements)."""
        bits = sum(1 + sum(x is not ANY and x is not HOST for x in p) for _, p in patterns)
        words = max(1, -(-bits // 64))
        self.enter, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start, self.last = np.zeros(words, np.uint64), []
        every, tail = np.arange(256), (np.arange(256) & 0xC0) == 0x80
        at = 0

        def put(table: np.ndarray, chars, bit: int) -> None:
            table[chars, bit // 64] |= np.uint64(1 << (bit % 64))

        for rule, pattern in patterns:
            put(self.start[None, :], 0, at)
            for x in pattern:
                if x is ANY:
                    put(self.stay, every, at)
                elif x is HOST:
                    put(self.stay, every[every != ord("/")], at)
                else:
                    at += 1
                    put(self.enter, every[~tail] if x is ONE else x, at)
                    if x is ONE:
                        put(self.stay, every[tail], at)  # the rest of one UTF-8 character
            self.last.append((rule, at))
            at += 1

    def run(self, urls: list[bytes]) -> list[set[int]]:
        """Numbers of the rules that match each URL."""
        out: list[set[int]] = []
        for s in range(0, len(urls), ROWS):
            out += self.batch(urls[s:s + ROWS])
        return out

    def batch(self, urls: list[bytes]) -> list[set[int]]:
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        lengths = np.array([len(urls[i]) for i in order])
        flat = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        d = np.tile(self.start, (len(urls), 1))
        for k in range(int(lengths[0]) if len(order) else 0):
            n = int(np.searchsorted(-lengths, -k, "left"))  # URLs longer than k come first
            c, x = flat[begin[:n] + k], d[:n]
            moved = x << np.uint64(1)
            moved[:, 1:] |= x[:, :-1] >> np.uint64(63)
            d[:n] = (moved & self.enter[c]) | (x & self.stay[c])
        found: list[set[int]] = [set() for _ in urls]
        for rule, bit in self.last:
            for i in np.flatnonzero(d[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)):
                found[order[i]].add(rule)
        return found


def judge(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[Glob] = (), *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, url, host, path, rule, verdict) of every row.

    The longest fitting Rule decides (ties: the first listed) and is named in `rule`. Else the first fitting Glob
    decides, else `default`; then `rule` is null. Null and malformed URLs have empty host and path and fit only
    globs that match the empty text. Repeated rows come out alike, an empty table gives no rows, other columns
    are not read. Rules are driver-side lists; a URL of any length is read whole.
    """
    everything = [*rules, *globs]
    automaton = Automaton([(i, p) for i, r in enumerate(everything) for p in r.globs()])
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def decide(fits: set[int]) -> tuple[str | None, str]:
        best = min((i for i in fits if i < len(rules)), key=lambda i: (-len(rules[i].name), i), default=None)
        if best is not None:
            return rules[best].name, rules[best].verdict
        return None, everything[min(fits)].verdict if fits else default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [canonical(u) for u in b.column("url").to_pylist()]
            made = [decide(f) for f in automaton.run([(h + p).encode("utf-8", "replace") for h, p in parts])]
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in made], [v for _, v in made]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.string()) for c in cols]], schema.names)

    return rows.mapInArrow(run, schema)
