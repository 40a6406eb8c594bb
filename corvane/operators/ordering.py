"""Ranks and samples by a total order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range partitioned by ``order`` with the partition's number in ``_part``.

    Written once: the range bounds come from a sample and could differ if it were computed again.
    """
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 under ``order``, which must be total.

    Rows are range partitioned, ranked within each partition and shifted by the
    counts of the partitions before; those counts, one a partition, are all that
    leaves the executors.
    """
    sorted_ = ranged(df, *order)
    counts = sorted(sorted_.groupBy("_part").count().collect())
    base, before = [], 0
    for p, n in counts:
        base.append((p, before))
        before += n
    at = df.sparkSession.createDataFrame(base, "_part int, _base long")
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn("_local", local).join(F.broadcast(at), "_part").withColumn(name, F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows (all if there are fewer), the least by sha256 of seed and key: a repeatable draw without replacement."""
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_rank", rank).orderBy("_rank", key).limit(n).drop("_rank")


def running_totals(df: DataFrame, group: str, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with running sums within ``group`` under ``order``: ``totals`` maps new columns to summed ones.

    Groups of any size are cut at range boundaries: sums run within a partition
    and are shifted by what earlier partitions hold of the group. Partitions
    times the groups they share, a bounded table, pass through a small join.
    """
    parts = ranged(df, F.col(group), *order)
    per = parts.groupBy(group, "_part").agg(*(F.sum(c).alias(n) for n, c in totals.items()))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(group, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in totals))
    w = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = parts.select("*", *(F.sum(c).over(w).alias(f"_r_{n}") for n, c in totals.items())).join(base, [group, "_part"])
    return run.select(*df.columns, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in totals))


def sequential(df: DataFrame, order: list[Column], step: object, schema: str) -> DataFrame:
    """Rows passed in ``order`` through ``step`` (iterator of batches to iterator of batches) in one task, as a stream.

    For folds that are sequential by definition; memory does not grow with the rows.
    """
    return df.orderBy(*order).coalesce(1).mapInPandas(step, schema)
