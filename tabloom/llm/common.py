"""What the operators share: word rules, fold numbers, written tables and batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.lineage import scratch

#: Separators of words and of stripped lines: space and 0x09 to 0x0D. bytes.split() without arguments cuts at exactly these.
SPACE = "\\x20\\x09-\\x0D"
BATCH_CHARS = 4_000_000
SLICE = 256


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "replace").lower().split()


def size_in_words(text: Column) -> Column:
    """Number of words, 0 for null: non-space characters that start a text or follow a space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def written(df: DataFrame) -> DataFrame:
    """Write once to the cluster's shared folder and read back: ends the lineage and survives lost executors."""
    path = scratch(df.sparkSession, "llm")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_udf(score: Callable[[list[str | None]], list], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function from texts to values that turns a few hundred texts of an Arrow batch to Python at a time."""

    @F.arrow_udf(kind)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [pa.array(score(batch.slice(s, SLICE).to_pylist()), arrow) for s in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return lambda text: run(text.cast("string"))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of `text`, or one row; nothing is left out."""
    for b in batches:
        size = b.column(text).nbytes
        step = max(1, int(b.num_rows * most / size)) if size else b.num_rows or 1
        for start in range(0, b.num_rows, step):
            yield b.slice(start, step)
