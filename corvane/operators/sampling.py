"""Repeatable splits and samples of the core: by hash rank, by group, by strata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_rank
from .ordering import global_rank, sequential


def round_robin(records: DataFrame, bucket: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows: one of each bucket in bucket order, then a second of each, and so on; within a bucket by hash rank."""
    rank = F.row_number().over(W.partitionBy(bucket).orderBy(hash_rank(seed, F.col(key).cast("string")), key))
    return records.withColumn("turn", rank).filter(F.col("turn") <= n).orderBy("turn", bucket).limit(n)


def negative_subsample(records: DataFrame, negative: str, key: str, multiplier: float, seed: int) -> DataFrame:
    """All positives and of the negatives at most positives x multiplier, rounded, by hash rank."""
    n = round(records.filter(~F.col(negative)).count() * multiplier)
    ranked = global_rank(records.filter(negative), [hash_rank(seed, F.col(key).cast("string")), F.col(key)], "_place")
    return records.filter(~F.col(negative)).unionByName(ranked.filter(F.col("_place") <= n).drop("_place"))


def validation_groups(records: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """(group, n, split): groups in hash order go to ``val`` until the fraction is reached; one group at least stays in ``train``."""
    g = records.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total, groups = g.agg(F.sum("n"), F.count(F.lit(1))).first()
    want = max(1, round((total or 0) * fraction))
    ranked = global_rank(g, [hash_rank(seed, F.col(group).cast("string")), F.col(group)], "r")
    # how many rows stand before each group in hash order, by ranges as in global_rank
    from .ordering import running_totals

    run = running_totals(ranked.withColumn("_one", F.lit(1)), "_one", [F.col("r")], {"upto": "n"})
    val = (F.col("upto") - F.col("n") < want) & ((F.col("r") < groups) | F.lit(groups == 1))
    return run.select(group, "n", F.when(val, "val").otherwise("train").alias("split"))


def balanced_groups(records: DataFrame, group: str, seed: int, validation: float, test: float) -> DataFrame:
    """(group, n, split): the largest group first, each to the split filled least against its target, ties by hash.

    The fold is sequential by definition, so the table of groups, one row each,
    streams through one task; rows of the groups never do. Large corpora use the
    annealed split of the training-data operators instead.
    """
    g = records.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    targets = {"test": round(total * test), "val": round(total * validation)}
    targets["train"] = total - sum(targets.values())
    names = list(targets)

    ranks = [hash_rank(seed, F.concat(F.col("grp"), F.lit(f":{n}"))).alias(f"r_{n}") for n in names]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = dict.fromkeys(names, 0)
        for pdf in batches:
            splits = []
            for r in pdf.itertuples(index=False):
                s = min(names, key=lambda k, r=r: (filled[k] / max(1, targets[k]), getattr(r, f"r_{k}")))
                filled[s] += r.n
                splits.append(s)
            yield pd.DataFrame({"grp": pdf["grp"], "n": pdf["n"], "split": splits})

    ordered = g.select("grp", "n", *ranks)
    return sequential(ordered, [F.desc("n"), hash_rank(seed, F.col("grp"))], step, "grp string, n bigint, split string").select(F.col("grp").alias(group), "n", "split")


def weighted_draw(weights: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """(draw, key): ``n`` draws with replacement in proportion to ``weight``; weights must average 1.

    Running weights give each row an interval; rows and draws meet in unit cells
    of that line, of which an interval covers about as many as its weight, so the
    range join is an equi-join without a hot key. Draw j follows from a digest of seed and j.
    """
    from .ordering import running_totals

    run = running_totals(weights.select(key, weight).withColumn("_one", F.lit(1)), "_one", [F.col(key)], {"hi": weight})
    total = run.agg(F.max("hi")).first()[0]
    if total is None:
        return weights.select(F.lit(0).cast("bigint").alias("draw"), key).limit(0)
    spans = run.withColumn("lo", F.col("hi") - F.col(weight)).select(key, "lo", "hi", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("cell"))
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double")
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (digest / F.lit(float(1 << 48)) * F.lit(float(total))).alias("u")).withColumn("cell", F.floor("u"))
    return draws.join(spans, "cell").filter((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).select("draw", key)
