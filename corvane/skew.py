"""Joins that stay whole and balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated apart, and only keys with at least so many rows.
#: A key that holds 1/HOT_KEYS of the rows or more is always among them.
HOT_KEYS, HOT_ROWS = 256, 20_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The up to ``HOT_KEYS`` most frequent values of ``key`` with ``HOT_ROWS`` rows or more.

    Counting is partially aggregated before its shuffle and the top is taken by
    a distributed top-k, so the driver sees at most ``HOT_KEYS`` values.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.filter(F.col("_n") >= HOT_ROWS).orderBy(F.desc("_n"), key).limit(HOT_KEYS)
    return [row[0] for row in top.collect()]


def _among(key: str, values: list) -> Column:
    return F.coalesce(F.col(key).isin(values), F.lit(False))


def lookup_join(many: DataFrame, one: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``many`` to ``one``, where ``one`` has at most one row a key.

    Rows of hot keys meet a broadcast of at most ``HOT_KEYS`` rows of ``one``;
    the others are shuffled. ``how`` is ``left`` or ``inner``; null keys match
    nothing. ``rows``, an upper bound of the rows of ``many`` where one is known,
    saves the search for hot keys when it leaves no room for any.
    """
    hot = hot_keys(many, key) if rows is None or rows >= HOT_ROWS else []
    if not hot:
        return many.join(one, key, how)
    few = F.broadcast(one.filter(_among(key, hot)))
    return (
        many.filter(~_among(key, hot)).join(one.filter(~_among(key, hot)), key, how)
        .unionByName(many.filter(_among(key, hot)).join(few, key, how))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Inner equi-join of two sides that may both repeat a key.

    A key hot on one side is spread over ``salts`` tasks, its partners being
    copied to each; a key hot on both is spread over a square of about as many,
    so that neither side is copied often. Every pair comes out exactly once.
    """
    a, b = set(hot_keys(left, key)), set(hot_keys(right, key))
    if not a | b:
        return left.join(right, key)
    side = max(2, round(salts**0.5))
    out = left.filter(~_among(key, list(a | b))).join(right.filter(~_among(key, list(a | b))), key)
    for keys, m, n in ((a - b, salts, 1), (b - a, 1, salts), (a & b, side, side)):
        if not keys:
            continue
        some = lambda df, keys=keys: df.filter(_among(key, list(keys)))
        own = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        x = some(left).withColumn("_row", own(left, m)).withColumn("_col", every(n))
        y = some(right).withColumn("_col", own(right, n)).withColumn("_row", every(m))
        out = out.unionByName(x.join(y, [key, "_row", "_col"]).drop("_row", "_col"))
    return out
