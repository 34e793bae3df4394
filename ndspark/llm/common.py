"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_folder, staged

__all__ = ["cut", "in_fold", "labelled_sample", "partitions", "shared_folder", "slices", "table"]

#: Rows turned into Python objects at a time; bounds a worker's memory whatever the Arrow batch holds.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; later reads survive lost executors."""
    return staged(df)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(y, text) of at most about per_class labelled documents of each class, and how many rows each
    stands for. Held-out ids never come in; which of the others do depends on the id alone."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_class / n) for y, n in totals.items()}
    if len(totals) < 2:
        return docs.select(F.lit(0).alias("y"), F.col(text_col).alias("text")).limit(0), {}
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    # about 2 * per_class short rows
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("id")).select("y", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return sample, {y: 1 / share[y] for y in share}
