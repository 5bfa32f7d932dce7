"""Private multiplicative weights: cell weights of column groups moved towards noisy answers of range counts.

The table is read once for each group: its cells are counted and every range of the pool is answered from
these counts. What moves afterwards is a model whose size follows the number of rounds, not the rows, the bins or
the levels: a weight is a product of one factor for each measured range that holds the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.draws import draw, interval_table
from tabloom.functions.rng import pick, u01
from tabloom.functions.tables import materialise
from tabloom.operators.generate import Coded, _grid, blank, code_table
from tabloom.operators.ledger import Ledger, spend
from tabloom.operators.private_models import generator
from tabloom.operators.scale import Bins
from tabloom.spec import TableSpec

#: Regions a model may have (see Factors); a group whose columns would need more must be split by the caller.
REGIONS = 4_000_000


def random_ranges(sizes: Sequence[int], queries: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of random boxes of codes, high exclusive; one row a query."""
    ends = np.sort(np.stack([rng.integers(0, s, (queries, 2)) for s in sizes], axis=1), axis=2)
    return ends[:, :, 0], ends[:, :, 1] + 1


def range_counts(codes: DataFrame, cols: Sequence[str], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows inside each box, by one pass. Rows with a null code are in no box.

    Equal cells are counted before the shuffle; a task then adds its cells up and sends one number a box.
    """
    cells = codes.dropna(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("_n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(low))
        for b in batches:
            inside = np.ones((b.num_rows, len(low)), bool)
            for k, c in enumerate(cols):
                x = b.column(c).to_numpy(zero_copy_only=False)[:, None]
                inside &= (x >= low[:, k]) & (x < high[:, k])
            total += b.column("_n").to_numpy(zero_copy_only=False).astype(float) @ inside
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(total)], ["box", "n"])

    got = cells.mapInArrow(add, "box int, n double").groupBy("box").agg(F.sum("n").alias("n")).collect()  # one row a box
    out = np.zeros(len(low))
    for r in got:
        out[r["box"]] = r["n"]
    return out


class Factors:
    """Weights over a grid of codes with a fixed total: even at first, times exp(rate) inside each measured box.

    Weights are constant between the ends of measured boxes. Cutting every axis there leaves at most
    2 * rounds + 1 segments an axis, so `mass` has one entry for each region of the product of these segments.
    """

    def __init__(self, sizes: Sequence[int], total: float):
        self.sizes, self.total = list(sizes), float(total)
        self.ends = [np.array([0, s]) for s in sizes]
        self.mass = np.full([1] * len(sizes), self.total)
        self.size = self.total  # of mass, which is scaled only where it is read
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.rates: list[float] = []

    def add_box(self, low: np.ndarray, high: np.ndarray) -> int:
        """A new measured box, with rate 0; segments are cut at its ends and share their mass by length."""
        for k in range(len(self.sizes)):
            old = self.ends[k]
            self.ends[k] = np.union1d(old, [low[k], high[k]])
            home = np.searchsorted(old, self.ends[k][:-1], side="right") - 1
            share = np.diff(self.ends[k]) / np.diff(old)[home]
            shape = [-1 if i == k else 1 for i in range(len(self.sizes))]
            self.mass = np.take(self.mass, home, axis=k) * share.reshape(shape)
        self.boxes.append((np.asarray(low), np.asarray(high)))
        self.rates.append(0.0)
        return len(self.rates) - 1

    def inside(self, j: int) -> tuple[slice, ...]:
        return tuple(slice(*np.searchsorted(e, [lo, hi])) for e, lo, hi in zip(self.ends, *self.boxes[j], strict=True))

    def fit(self, answers: Sequence[float], passes: int) -> None:
        """Passes over all measured boxes; a box's weights move by exp((answer - modelled answer) / (2 total))."""
        parts = [self.mass[self.inside(j)] for j in range(len(answers))]  # views
        for _ in range(passes):
            for j, part in enumerate(parts):
                held = float(part.sum())
                rate = (answers[j] - held * self.total / self.size) / (2 * self.total)
                part *= math.exp(rate)
                self.size += held * math.expm1(rate)
                self.rates[j] += rate
        self.mass *= self.total / self.mass.sum()
        self.size = self.total

    def answers(self, low: np.ndarray, high: np.ndarray, block: int = 64) -> np.ndarray:
        """Modelled answers of any boxes: the mass, weighed on each axis by the share of a segment inside the box."""
        out = []
        for s in range(0, len(low), block):
            held = None
            for k, e in enumerate(self.ends):
                lo, hi = low[s:s + block, k, None], high[s:s + block, k, None]
                share = np.clip(np.minimum(hi, e[1:]) - np.maximum(lo, e[:-1]), 0, None) / np.diff(e)
                held = np.tensordot(share, self.mass, (1, 0)) if held is None else np.einsum("qs...,qs->q...", held, share)
            out.append(held)
        return np.concatenate(out)

    def regions(self, spark, cols: Sequence[str]) -> DataFrame:
        """(_region, w, first code and number of codes of each column): the regions and their weight, made on the executors."""
        axes = [f"_s{k}" for k in range(len(cols))]
        widths = [len(e) - 1 for e in self.ends]
        rows = _grid(spark, widths, axes)
        top = np.zeros(widths)
        for j, rate in enumerate(self.rates):
            top[self.inside(j)] += rate
        region, log_weight = F.lit(0).cast("long"), F.lit(-float(top.max()))  # the heaviest cells weigh 1
        for s, n in zip(axes, widths, strict=True):
            region = region * n + F.col(s)
        for j, rate in enumerate(self.rates):
            box = F.lit(True)
            for s, cut in zip(axes, self.inside(j), strict=True):
                box = box & F.col(s).between(int(cut.start), int(cut.stop) - 1)
            log_weight = log_weight + F.when(box, float(rate)).otherwise(0.0)
        at = lambda values, s: F.element_at(F.array(*map(F.lit, values.tolist())), F.col(s) + 1)
        first = [at(e[:-1], s).alias(f"_first_{c}") for e, s, c in zip(self.ends, axes, cols, strict=True)]
        size = [at(np.diff(e), s).alias(f"_size_{c}") for e, s, c in zip(self.ends, axes, cols, strict=True)]
        rows = rows.select(region.alias("_region"), F.exp(log_weight).alias("w"), *first, *size)
        cells = F.lit(1.0)
        for c in cols:
            cells = cells * F.col(f"_size_{c}")
        return rows.withColumn("w", F.col("w") * cells)


@dataclass
class CellModel:
    """Independent groups of columns, each a table of regions of even weight."""

    coded: Coded
    groups: list[tuple[list[str], DataFrame]]
    factors: list[Factors]

    def sample(self, n: int, seed=0) -> DataFrame:
        df = blank(self.coded.df.sparkSession, n)
        for i, (cols, regions) in enumerate(self.groups):
            law = interval_table(regions, [], "_region", "w")
            df = draw(df, law, [], "_region", u01(seed, f"group-{i}", "row"), "_region_drawn")
            df = df.join(regions.withColumnRenamed("_region", "_region_drawn"), "_region_drawn")
            for c in cols:
                df = df.withColumn(c, (F.col(f"_first_{c}") + pick(u01(seed, f"cell-{c}", "row"), F.col(f"_size_{c}")) - 1).cast("int"))
            df = df.select("row", *[c for g, _ in self.groups[:i + 1] for c in g])
        return self.coded.decode(df.select("row", *self.coded.cols))


def fit_multiplicative_weights(df: DataFrame, spec: TableSpec, bounds: Mapping[str, tuple[float, float]], epsilon: float = 3.0, *,
                               groups: Sequence[Sequence[str]] | None = None, bins: int = 500, queries: int = 400, rounds: int = 30, inner: int = 20,
                               ledger: Ledger | None = None, seed=None) -> CellModel:
    """Each round picks the range of the pool that the model answers worst (exponential mechanism), measures it with
    Laplace noise and refits all measured ranges in `inner` passes. Groups share epsilon evenly and are independent.

    `bounds` of the numeric columns are given, since bins read from the data would leak them; the number of rows and
    the lists of levels count as known. A range is measured once, so the pool must hold at least `rounds` of them.
    An empty table leaves an even model; null features are left out of the counts.
    """
    missing = set(spec.numeric) - set(bounds)
    if missing:
        raise ValueError(f"bounds required for {sorted(missing)}")
    if queries < rounds:
        raise ValueError("as many queries as rounds are needed")
    rng = generator(seed)
    coded = code_table(df, spec, Bins({c: bounds[c] for c in spec.numeric}, bins) if spec.numeric else None)
    groups = [list(g) for g in (groups or [coded.cols])]
    if sorted(c for g in groups for c in g) != sorted(coded.cols):
        raise ValueError("groups must hold every column once")
    for g in groups:
        if math.prod(min(coded.sizes[c], 2 * rounds + 1) for c in g) > REGIONS:
            raise ValueError(f"split the group {g}: its model could have more than {REGIONS} regions")
    spend(ledger, epsilon)
    codes = materialise(coded.df)
    total = codes.count()
    step = epsilon / len(groups) / (2 * rounds)
    made, fitted = [], []
    for cols in groups:
        sizes = [coded.sizes[c] for c in cols]
        model = Factors(sizes, total)
        if total:
            low, high = random_ranges(sizes, queries, rng)
            true, free, noisy = range_counts(codes, cols, low, high), np.ones(queries, bool), []
            for _ in range(rounds):
                score = np.abs(true - model.answers(low, high)) * step / 2 + rng.gumbel(size=queries)
                worst = int(np.where(free, score, -np.inf).argmax())
                free[worst] = False
                model.add_box(low[worst], high[worst])
                noisy.append(min(max(true[worst] + rng.laplace(0, 1 / step), 0.0), total))  # counts lie between 0 and the known total
                model.fit(noisy, inner)
        made.append((cols, materialise(model.regions(df.sparkSession, cols))))
        fitted.append(model)
    return CellModel(coded, made, fitted)
