"""Compare registered queries with their DuckDB oracle: python check.py SF_DIR [name prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from tabloom.functions.lineage import release
from tabloom.plans import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
    )
    if "SPARK_CHECKPOINT_DIR" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARK_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / (t + '.parquet')}'")
    return con


def canonical(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        return repr(v)

    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, entry) -> tuple[str, str]:
    df = entry.run(spark, sf_dir)
    rows = df.collect()
    if entry.sql is None:
        return "rows", f"{len(rows)} rows"
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "BAD", f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = canonical(rows, df.columns), canonical(expected, cols)
    note = [f"{n}: {t} vs {types[n]}" for n, t in df.dtypes if TYPES.get(t, types[n]) != types[n]]
    if a != b:
        return "BAD", f"{len(rows)} vs {len(expected)} rows; only spark {list((a - b).items())[:2]}; only oracle {list((b - a).items())[:2]} {note}"
    if note:
        return "TYPE", "; ".join(note)
    return "ok", f"{len(rows)} rows"


def main() -> int:
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con, bad = session(), duck(sf_dir), 0
    for name, entry in load_all().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            status, text = compare(spark, con, sf_dir, entry)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            status, text = "ERR", f"{type(e).__name__}: {str(e)[:700]}"
        release(spark)
        bad += status not in ("ok", "rows")
        print(f"{status:4} {name:40} {time.time() - t:6.2f}s {text}", flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
