import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.lineage import scratch
from tabloom.operators.ledger import BudgetError, Ledger
from tabloom.streaming.moments import BlockStore, blocks, error_bound, read_moments, run_moments

SCHEMA = "x double, y double"


def arrive(spark, folder, parts):
    """One file, and so one batch, for each array."""
    for x in parts:
        rows = [(None if math.isnan(v) else float(v), float(i)) for i, v in enumerate(x)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("t", range(1, 70))
def test_blocks_add_up(t):
    ends = blocks(t)
    starts = [0, *ends[:-1]]
    assert ends[-1] == t and len(ends) == t.bit_count()
    assert all(e - s == e & -e for s, e in zip(starts, ends, strict=True))  # a block is as long as the lowest bit of its end
    new = t & -t
    done = blocks(t - 1)[len(ends) - 1:]  # what batch t completes
    assert sum(e & -e for e in done) == new - 1 and blocks(t - 1)[:len(ends) - 1] == ends[:-1]


def test_state_stays_small_and_exact_over_restarts(spark):
    rng, folder, state, progress = np.random.default_rng(3), *(scratch(spark, n) for n in ("arriving", "state", "progress"))
    first, more = [rng.normal(5, 2, 30) for _ in range(9)], [np.array([math.nan, 7.0]), np.array([]), np.array([1e6])]
    arrive(spark, folder, first)
    got = run_moments(stream(spark, folder), ["x"], state, progress).first()
    x = np.concatenate(first)
    assert got["n"] == 270 and got["mean"] == pytest.approx(x.mean()) and got["m2"] / 270 == pytest.approx(x.var())
    assert len(BlockStore(spark, state).listed()) <= 2 * math.log2(9) + 2
    arrive(spark, folder, more)
    got = run_moments(stream(spark, folder), ["x"], state, progress).first()
    x = np.concatenate([*first, [7.0, 1e6]])
    assert got["n"] == 272 and got["mean"] == pytest.approx(x.mean()) and got["m2"] / 272 == pytest.approx(x.var())
    last = sorted(Path(progress, "commits").glob("[0-9]*"), key=lambda f: int(f.name))[-1]
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)  # as if the driver had died before it noted the last batch, which now comes again
    again = run_moments(stream(spark, folder), ["x"], state, progress).first()
    assert again == got


def test_private_release_keeps_its_bound_and_budget(spark):
    rng, folder, state, progress = np.random.default_rng(4), *(scratch(spark, n) for n in ("arriving", "state", "progress"))
    bounds, epsilon, horizon = {"x": (0.0, 10.0)}, 20.0, 8
    parts = [rng.uniform(0, 12, 500) for _ in range(5)]
    arrive(spark, folder, parts)
    ledger = Ledger(30.0)
    args = {"bounds": bounds, "epsilon": epsilon, "horizon": horizon, "ledger": ledger, "seed": 5}
    got = run_moments(stream(spark, folder), ["x"], state, progress, **args).first()
    x = np.clip(np.concatenate(parts), 0, 10)
    count, total, _ = error_bound(bounds, epsilon, horizon, 1e-4)["x"]
    assert abs(got["n"] - len(x)) <= count + 1 and got["n"] != len(x)
    assert abs(got["n"] * (got["mean"] - 5) - (x - 5).sum()) <= total + 1
    assert got["mean"] == pytest.approx(x.mean(), abs=0.2) and got["m2"] / got["n"] == pytest.approx(x.var(), abs=0.7)
    assert read_moments(spark, state, bounds).first() == got  # noise is drawn once
    assert ledger.total()[0] == pytest.approx(20.0)
    run_moments(stream(spark, folder), ["x"], state, progress, **args)  # nothing new arrives, nothing is charged
    assert ledger.total()[0] == pytest.approx(20.0)
    with pytest.raises(BudgetError):
        run_moments(stream(spark, folder), ["x"], scratch(spark, "state"), scratch(spark, "progress"), **args)
    with pytest.raises(ValueError, match="bounds"):
        run_moments(stream(spark, folder), ["x", "y"], state, progress, **args)
    arrive(spark, folder, parts[:4])
    with pytest.raises(Exception, match="8 batches"):  # the ninth
        run_moments(stream(spark, folder), ["x"], state, progress, **args)


def test_no_batch_gives_no_row(spark):
    folder = scratch(spark, "arriving")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert run_moments(stream(spark, folder).where(F.lit(False)), ["x"], scratch(spark, "state"), scratch(spark, "progress")).count() == 0
