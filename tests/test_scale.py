"""Skew-safe joins and ranks give what the plain ones give."""

import math

import pytest
from pyspark.sql import functions as F

from corvane import skew
from corvane.operators import similarity
from corvane.operators.components import star_components
from corvane.operators.ordering import global_rank, running_totals
from corvane.operators.similarity import near_hash_pairs
from corvane.plans.profile import upper_median
from corvane.plans.registry import queries
from corvane.session import bounded_values

QUERIES = queries()


def test_joins_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    many = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 40).alias("k"), "id")
    one = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        assert sorted(map(str, skew.lookup_join(many, one, "k", how).collect())) == sorted(map(str, many.join(one, "k", how).collect()))
    pairs = spark.range(90).select((F.col("id") % 30).alias("k"), F.col("id").alias("w"))
    assert sorted(map(str, skew.salted_join(many, pairs, "k", 4).collect())) == sorted(map(str, many.join(pairs, "k").collect()))
    assert skew.hot_keys(many, "k") == [0]
    hot = spark.range(200).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5 + 1).alias("k"), F.col("id").alias("w"))
    for a, b in ((many, hot), (pairs, hot), (hot, pairs)):
        b = b.withColumnRenamed("w", "z") if "w" in a.columns else b
        assert sorted(map(str, skew.salted_join(a, b, "k", 4).collect())) == sorted(map(str, a.join(b, "k").collect()))


def test_ranks_and_totals(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"))
    got = {r["id"]: r["r"] for r in global_rank(df, [F.col("x"), F.col("id")], "r").collect()}
    want = {r["id"]: k + 1 for k, r in enumerate(sorted(df.collect(), key=lambda r: (r["x"], r["id"])))}
    assert got == want
    sums = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], r["x"], r["id"])):
        sums[r["id"]] = sums.get(("g", r["g"]), 0) + r["x"]
        sums["g", r["g"]] = sums[r["id"]]
    run = running_totals(df, "g", [F.col("x"), F.col("id")], {"s": "x"})
    assert all(sums[r["id"]] == r["s"] for r in run.collect())
    xs = sorted(r["x"] for r in df.collect())
    assert upper_median(df, "x") == xs[len(xs) // 2] and upper_median(df.limit(0), "x") is None


def test_components_raise_rather_than_stop_short(spark):
    path = spark.range(64).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in star_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        star_components(path, max_rounds=1)


def test_bounded_values_refuse_more(spark):
    df = spark.range(5).select(F.when(F.col("id") > 0, F.col("id")).alias("k")).unionByName(spark.range(5).select(F.col("id").alias("k")))
    assert bounded_values(df, "k", 5) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        bounded_values(df, "k", 4)


def test_near_hash_lists_widen_with_the_hashes(spark):
    """The same pairs from every plan, and candidates that grow with the hashes, not with their square."""
    base = spark.range(300).select(F.xxhash64("id").alias("h"))
    near = base.select(F.col("h").bitwiseXOR(F.lit(0b10001000100010001)).alias("h")).unionByName(base).unionByName(base.limit(5))
    rows = [r["h"] for r in near.distinct().collect()]
    want = {(g, h) for g in rows for h in rows if ((g ^ h) & (2**64 - 1)).bit_count() <= 5}
    got = [(r["g"], r["h"]) for r in near_hash_pairs(near, near, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for k in (1, 2, 3):
        plan = similarity.Blocks(similarity.block_plan(2 ** (64 * k // (5 + k)), 5).masks, k)
        lists = similarity.block_lists(near.distinct().select(F.col("h").alias("g")), "g", plan)
        pairs = lists.join(similarity.block_lists(near.distinct(), "h", plan).select("h", "key"), "key").filter(similarity.first_equal(F.col("g"), F.col("h"), plan))
        pairs = pairs.filter(F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= 5)
        assert sorted((r["g"], r["h"]) for r in pairs.select("g", "h").collect()) == sorted(want)

    for n in (1_600, 4_000, 64_000):  # by chance a hash meets one other a list at most
        h, plan = spark.range(n).select(F.xxhash64(F.lit("r"), "id").alias("g")), similarity.block_plan(n, 5)
        pairs = similarity.block_lists(h, "g", plan).join(similarity.block_lists(h.select(F.col("g").alias("h")), "h", plan).select("h", "key"), "key")
        assert pairs.filter("g <> h").count() <= 1.5 * n * math.comb(len(plan.masks), plan.equal)
    assert [similarity.block_plan(10**e, 5).equal for e in (3, 5, 7, 9)] == [1, 2, 3, 5]


def bits_apart(g, h):
    return ((g ^ h) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("mean, most", [(1 << 12, 1 << 20), (4, 10)])
def test_near_hashes_in_cells_and_parts(spark, monkeypatch, mean, most):
    """Two sides, nulls, repeats, extreme values; cells narrow and dealt into parts or not."""
    monkeypatch.setattr(similarity, "CELL_MEAN", mean)
    monkeypatch.setattr(similarity, "CELL_ROWS", most)
    a = [r[0] for r in spark.range(60).select(F.xxhash64("id")).collect()] + [0, -1, 2**63 - 1, -(2**63)] + list(range(20))
    b = [h ^ 0b10000010001 for h in a] + a[:9] + a[:3]
    left, right = (spark.createDataFrame([(h,) for h in [*x, None]], "h bigint") for x in (a, b))
    for one, other, x, y in ((left, right, a, b), (left, left, a, a)):
        got = [tuple(r) for r in near_hash_pairs(one, other, 5).collect()]
        assert sorted(got) == sorted((g, h, bits_apart(g, h)) for g in set(x) for h in set(y) if bits_apart(g, h) <= 5)
    assert near_hash_pairs(left.limit(0), left.limit(0), 5).count() == near_hash_pairs(left, right.limit(0), 5).count() == 0


def test_near_hashes_are_not_broadcast(spark, data):
    """The lists of blocks outgrow every estimate, so neither they nor the pairs may be broadcast, whatever the threshold."""
    h = spark.range(3000).select(F.xxhash64("id").alias("h"))
    plan = near_hash_pairs(h, h, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    first = QUERIES["jn6_ordered_near_hashes"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in first.split("SortMergeJoin")[-1] and first.count("BroadcastHashJoin") <= 1


def test_two_bands_are_not_broadcast(spark, data):
    """At Spark's own threshold of 10 MB the lists of jn7's hashes went to the driver whole, more than it takes at 0.1 GB."""
    plan = QUERIES["jn7_two_bands"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_near_images_are_not_broadcast(spark, data):
    """Neither while the pairs are made nor when they are expanded to images."""
    plans, cut = [], similarity.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(similarity, "cut", lambda df: plans.append(plan(df)) or cut(df))
        df = QUERIES["jn5_near_hashes"](spark, data)
    assert plans and not any("Broadcast" in p for p in [*plans, plan(df)])


def test_near_hashes_shuffle_a_row_a_block(spark, data):
    """However many lists there are, a hash is shuffled once for each block that can be the first of one, and for each part of a crowded cell."""
    h = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(3).alias("side"))
    for rows, lists in ((500_000, 84), (10**8, 462)):
        plan = similarity.block_plan(rows, 6)
        assert math.comb(len(plan.masks), plan.equal) == lists
        assert similarity.cell_rows(h, plan, 4000).count() == 7 * 4000
    got = {(r["g"], r["h"]): r["band"] for r in QUERIES["jn7_two_bands"](spark, data).collect()}
    x = {r[0] for r in spark.read.parquet(f"{data}/audit_yolo_detection_dataset.parquet").select("phash").collect()} - {None}
    assert got == {(g, h): "union" if bits_apart(g, h) <= 2 else "suspicious" for g in x for h in x if g < h and bits_apart(g, h) <= 6}
