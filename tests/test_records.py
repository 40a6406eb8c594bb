"""Record operators without a statement in SQL, against plain loops, and their special cases."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import hashing as H
from corvane.operators import records as R
from corvane.plans import registry


def test_quarantine_refuses_what_is_not_there(spark):
    df, listed = spark.range(5).withColumn("x", F.lit(1)), spark.createDataFrame([(1,), (1,), (None,), (3,)], "id bigint")
    assert sorted(r["id"] for r in R.quarantine(df, listed, "id").collect()) == [0, 2, 4]
    with pytest.raises(ValueError):
        R.quarantine(df, spark.createDataFrame([(9,)], "id bigint"), "id")
    assert R.quarantine(df, listed.limit(0), "id").count() == 5


def test_upsert_is_idempotent_and_refuses_conflicts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "b", 2), (3, "c", 3), (3, "c", 3), (None, "z", 0)], "id int, x string, y int")
    want = [(1, "a", None), (2, "b", 2), (3, "c", 3)]
    assert sorted(map(tuple, R.upsert(old, new, "id").collect())) == want
    assert sorted(map(tuple, R.upsert(R.upsert(old, new, "id"), new, "id").collect())) == want
    with pytest.raises(Exception, match="two payloads for 1"):
        R.upsert(old, spark.createDataFrame([(1, "a", 5)], "id int, x string, y int"), "id").collect()


def test_related_groups_on_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/audit_yolo_detection_dataset.parquet").select("record_id", "image_path", "image_sha256", "phash", H.asset_key(F.col("image_path")).alias("a"), H.video_group(F.col("image_path")).alias("v")).collect()
    root = {r["record_id"]: r["record_id"] for r in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    hubs, hashes = defaultdict(set), defaultdict(set)
    for r in rows:
        for k in ("image_sha256", "a", "v"):
            if r[k]:
                hubs[k, r[k]].add(r["record_id"])
        if r["phash"] is not None:
            hashes[r["phash"]].add(r["record_id"])
    for g in hashes:
        for h in hashes:
            if ((g ^ h) & (2**64 - 1)).bit_count() <= 2:
                hubs["h", min(g, h), max(g, h)] |= hashes[g] | hashes[h]
    for ids in hubs.values():
        first = min(ids)
        for i in ids:
            root[find(i)] = find(first)
    path, members = {}, defaultdict(set)
    for r in rows:
        members[find(r["record_id"])].add(r["record_id"])
        path[find(r["record_id"])] = min(filter(None, (path.get(find(r["record_id"])), r["image_path"])))
    number = {k: n for n, k in enumerate(sorted(members, key=lambda k: path[k]), 1)}
    got = {r["record_id"]: (r["group_no"], r["group_size"]) for r in registry.queries()["st6_related_groups"](spark, data).collect()}
    assert got == {i: (number[k], len(ids)) for k, ids in members.items() for i in ids}


def test_frequency_hash_equals_its_definition(spark):
    grid = [(i * 37 + i * i % 101) % 256 for i in range(1024)]

    def coefficient(u, v):
        scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
        return scale(u) * scale(v) * sum(grid[32 * y + x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))

    want = [coefficient(k // 8, k % 8) for k in range(64)]
    df = spark.createDataFrame([(grid,), ([1, 2],), (None,)], "g array<int>").select(H.low_frequencies("g").alias("f"))
    rows = [r["f"] for r in df.select("f").collect()]
    assert rows[0] == pytest.approx(want, abs=1e-6) and rows[1:] == [None, None]
    m = sorted(want[1:])[31]
    r = df.filter("f is not null").select(H.bits_lsb_first(F.col("f")).alias("l"), H.bits_msb_first(F.col("f")).alias("m")).first()
    assert r["l"] & (2**64 - 1) == sum(1 << k for k in range(1, 64) if want[k] > m)
    assert r["m"] & (2**64 - 1) == sum(1 << 63 - k for k in range(64) if want[k] > m)


def test_sharpness_of_flat_empty_and_ragged_grids(spark):
    rows = [([7.0] * 12, 4), ([0.0, 0.0, 255.0, 255.0] * 3, 4), ([], 4), (None, 4), ([1.0] * 5, 4)]
    df = spark.createDataFrame(rows, "g array<double>, c int").select(H.sharpness("g", "c", F.lit(100.0)).alias("s")).select("s.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (0.0, 0.0) and got[1] == (255.0**2 / 2, 0.5) and got[2:] == [(None, None)] * 3


def test_json_lines_errors(spark):
    lines = spark.createDataFrame([("f", 1, '{"image_id": "a"}'), ("f", 2, ""), ("f", 3, '{"image_id": '), ("f", 4, "7")], "file string, line_no int, raw string")
    got = {r["line_no"]: r["error"] for r in R.json_lines_errors(lines, "image_id string").collect()}
    assert got == {1: None, 3: "invalid_json", 4: "invalid_json"}
