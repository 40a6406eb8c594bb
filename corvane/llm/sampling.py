"""Problem 2: samples of instances that meet target category shares and floors.

Systematic sampling with unequal probabilities: within the sorted categories the
instances lie in a random but repeatable order; the inclusion probabilities are
summed along that order across partitions, and an instance is taken where the
sum passes an integer counted from one random start. A floor that the sweep left
unmet is then filled with the next instances of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Each category's order is divided into so many runs by the leading bits of its random order.
RUNS = 1024


def latest_images(records: DataFrame) -> DataFrame:
    """(image_id, row_id, attrs, classes): one row for each non-null image_id, the one with the greatest updated_at.

    A null updated_at comes last; of ties, which are alike, the greatest row_id is taken. Only the two fields of the instances that name
    a category are read.
    """
    slim = records.filter("image_id is not null").select(
        "image_id", "updated_at", "row_id", F.col("instances.attr_id").alias("attrs"), F.col("instances.class_id").alias("classes")
    )
    return slim.groupBy("image_id").agg(F.max(F.struct("updated_at", "row_id", "attrs", "classes")).alias("r")).select("image_id", "r.row_id", "r.attrs", "r.classes")


def instance_categories(records: DataFrame, class_map: DataFrame) -> DataFrame:
    """(row_id, pos, attr_id) of the non-null instances of the latest images that have a category.

    The category is attr_id in lower case without outer blanks, else (null or
    blank) the class_map's attr_id for class_id; an instance with neither has none.
    """
    names = class_map.filter("class_id is not null").groupBy("class_id").agg(F.min("attr_id").alias("named"))
    zipped = F.arrays_zip("attrs", "classes")
    rows = latest_images(records).select("row_id", F.posexplode(zipped).alias("pos", "i"))
    own = F.lower(F.regexp_replace("i.attrs", r"^\s+|\s+$", ""))
    rows = rows.select("row_id", "pos", F.when(own != "", own).alias("own"), F.col("i.classes").alias("class_id"))
    # class_map is a fixed dimension: one row a class
    rows = rows.join(F.broadcast(names), "class_id", "left")
    return rows.select("row_id", "pos", F.coalesce("own", F.lower(F.trim("named"))).alias("attr_id")).filter("attr_id is not null")


def _ceil_share(total: Column, sample: Column, target: Column) -> Column:
    product = total * sample * target
    return F.floor((product + 999_999) / 1_000_000).cast("bigint")


def target_plan(instances: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, attr_id, available, want, take): want is the larger of min_count and the share, rounded up.

    take is want as far as instances are there. A category without instances
    has available 0. Repeated target rows of a plan and category count once.
    """
    counts = instances.groupBy("attr_id").agg(F.count(F.lit(1)).alias("available"))
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]  # one number
    wanted = targets.filter("plan_id is not null and attr_id is not null").withColumn("attr_id", F.lower(F.trim("attr_id")))
    wanted = wanted.groupBy("plan_id", "attr_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("decimal(20,0)").alias(c) for c in ("sample_permille", "target_permille", "min_count")))
    # as joined, counts has at most one row for each category of the targets
    plan = wanted.join(F.broadcast(counts.join(F.broadcast(wanted.select("attr_id").distinct()), "attr_id", "left_semi")), "attr_id", "left").withColumn("total", F.lit(total))
    share = _ceil_share(F.col("total").cast("decimal(18,0)"), F.col("sample_permille").cast("decimal(5,0)"), F.col("target_permille").cast("decimal(5,0)"))
    plan = plan.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("want", F.greatest(share, F.col("min_count").cast("bigint")))
    return plan.select("plan_id", "attr_id", "available", "want", F.least("want", "available").alias("take"), F.col("min_count").cast("bigint").alias("min_count"), share.alias("share_count"))


def _start(seed: int) -> Column:
    """The one random start of a plan, in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("plan_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _crossings(rank: Column) -> Column:
    """How many whole numbers, counted from the start, the summed probabilities of a category have passed at ``rank``.

    That is floor((rank x expected - start) / there), in whole numbers: the start is
    taken in parts of 1 / there, and where a bigint may not hold the product a
    decimal of 38 digits does.
    """
    there, start = F.col("there"), F.col("start")
    passed = lambda r, e, a, u: F.call_function("div", r * e - u + a, a).cast("bigint") - 1
    wide = lambda c: c.cast("decimal(18,0)")
    return F.when(there < 1 << 31, passed(rank, F.col("expected"), there, start)).otherwise(passed(wide(rank), wide(F.col("expected")), wide(there), wide(start)))


def proportional_sample(records: DataFrame, class_map: DataFrame, targets: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    sample: (plan_id, attr_id, row_id, pos), without repetition within a plan.
    report: (plan_id, attr_id, available, want, taken, short), taken being counted
    from the rows of the sample and short telling that they are fewer than wanted;
    a category that falls short is taken whole. Null instances, images without id
    and instances without category take no part; empty tables give an empty sample
    and a report of what is short.
    """
    every = cut(instance_categories(records, class_map))
    plan = cut(target_plan(every, targets))
    # A random order by hash: its leading bits divide a category into runs, so no task sorts a whole category.
    order = F.xxhash64(F.lit(seed), "row_id", "pos")
    keyed = every.withColumn("o", order).withColumn("run", F.shiftrightunsigned("o", 64 - RUNS.bit_length() + 1).cast("int"))
    keyed = keyed.join(F.broadcast(plan.select("attr_id").distinct()), "attr_id", "left_semi")
    runs = keyed.groupBy("attr_id", "run").agg(F.count(F.lit(1)).alias("n"))
    offsets = runs.select("attr_id", "run", (F.sum("n").over(W.partitionBy("attr_id").orderBy("run")) - F.col("n")).alias("before"))
    place = W.partitionBy("attr_id", "run").orderBy(F.shiftleft("o", RUNS.bit_length() - 1), "row_id", "pos")
    # at most RUNS rows a category of the targets
    ranked = keyed.withColumn("k", F.row_number().over(place)).join(F.broadcast(offsets), ["attr_id", "run"]).select("attr_id", "row_id", "pos", (F.col("before") + F.col("k")).alias("rank"))
    # In sorted order of the categories the probabilities before one sum to a whole number, the shares before it, so that number drops out.
    there = F.greatest(F.col("available"), F.lit(1))
    sweep = plan.select(
        "plan_id", "attr_id", "available", "take", F.least(F.greatest("share_count", F.lit(0)), "available").alias("expected"), there.alias("there"),
        F.least(F.floor(_start(seed) * there), there - 1).alias("start"),
    )
    # What a floor still lacks comes from the first instances that the sweep passes over.
    sweep = sweep.withColumn("first", _crossings(F.lit(0).cast("bigint")))
    sweep = sweep.withColumn("lacking", F.greatest(F.col("take") - (_crossings(F.col("available")) - F.col("first")), F.lit(0)))
    drawn = ranked.join(F.broadcast(sweep), "attr_id").filter((F.col("expected") > 0) | (F.col("lacking") > 0))
    drawn = drawn.select("plan_id", "attr_id", "row_id", "pos", "rank", "first", "lacking", _crossings(F.col("rank")).alias("passed"), _crossings(F.col("rank") - 1).alias("before"))
    picked = F.col("passed") > F.col("before")
    filled = ~picked & (F.col("rank") - (F.col("passed") - F.col("first")) <= F.col("lacking"))
    sample = cut(drawn.filter(picked | filled).select("plan_id", "attr_id", "row_id", "pos"))
    taken = sample.groupBy("plan_id", "attr_id").agg(F.count(F.lit(1)).alias("taken"))
    # at most one row a target row
    report = plan.join(F.broadcast(taken), ["plan_id", "attr_id"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return sample, report.select("plan_id", "attr_id", "available", "want", "taken", (F.col("taken") < F.col("want")).alias("short"))
