"""Matching, coverage, components and suppression against plain versions."""

import random

import numpy as np

from corvane.operators import matching as M
from corvane.operators.components import star_components


def boxes(rng, n, image):
    return [(image, 1, k, rng.randrange(40), rng.randrange(40), rng.randrange(1, 20), rng.randrange(1, 20)) for k in range(n)]


T = "image_id int, class_id int, id int, x0 int, y0 int, w int, h int"


def sides(spark, seed=0, images=12):
    rng = random.Random(seed)
    t = [b for i in range(images) for b in boxes(rng, rng.randrange(5), i)]
    d = [(*b, rng.choice([0.2, 0.5, 0.5, 0.9])) for i in range(images) for b in boxes(rng, rng.randrange(6), i)]
    return t, d, spark.createDataFrame(t, T), spark.createDataFrame(d, T + ", score double")


def pixels(bs):
    m = np.zeros((70, 70), bool)
    for b in bs:
        m[b[4] : b[4] + b[6], b[3] : b[3] + b[5]] = True
    return m


def test_coverage_equals_pixels(spark):
    t, d, tt, dd = sides(spark, 1)
    for r in M.coverage(tt, dd, ["image_id"]).collect():
        a, b = pixels([x for x in t if x[0] == r["image_id"]]), pixels([x for x in d if x[0] == r["image_id"]])
        assert (r["truth_area"], r["covered_area"], r["extra_area"]) == (a.sum(), (a & b).sum(), (b & ~a).sum())


def test_components_equal_flood(spark):
    rng = random.Random(3)
    rows = [b for i in range(6) for b in boxes(rng, 8, i)]
    got = {(r["image_id"], r["id"]): r["component"] for r in M.touching_components(spark.createDataFrame(rows, T), ["image_id"]).collect()}
    touch = lambda a, b: a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5] and a[4] <= b[4] + b[6] and b[4] <= a[4] + a[6]
    for i in range(6):
        own = [b for b in rows if b[0] == i]
        label = {b[2]: b[2] for b in own}
        for _ in own:
            for a in own:
                for b in own:
                    if touch(a, b):
                        label[a[2]] = label[b[2]] = min(label[a[2]], label[b[2]])
        assert all(got[i, b[2]] == label[b[2]] for b in own)


def test_greedy_order_and_ties():
    iou = np.array([[0.6, 0.6], [0.9, 0.0]])
    assert M.greedy(iou, 0.5).tolist() == [0, -1]
    assert M.greedy(np.zeros((2, 0)), 0.5).tolist() == [-1, -1]
    assert M.greedy(np.zeros((1, 1)), 0.0).tolist() == [-1]


def test_perfect_detections_score_one(spark):
    t, _, tt, _ = sides(spark, 2)
    from pyspark.sql import functions as F

    r = M.coco_statistics(tt, tt.withColumn("score", F.lit(0.9))).first()
    assert abs(r["ap"] - 1) < 1e-9 and abs(r["ar_100"] - 1) < 1e-9 and r["ap_large"] == -1


def test_counts_with_no_truth_or_no_detection(spark):
    _, _, tt, dd = sides(spark, 2)
    none = M.match_counts(tt.limit(0), dd, ["image_id", "class_id"], [0.5]).groupBy().sum("tp", "fp", "fn").first()
    assert none[0] == 0 and none[1] == dd.filter("score >= 0.5").count() and none[2] == 0
    assert M.match_counts(tt.limit(0), dd.limit(0), ["image_id"], [0.5]).count() == 0


def test_suppression(spark):
    rows = [(1, 1, 0, 0, 0, 10, 10, 0.9), (1, 1, 1, 1, 0, 10, 10, 0.8), (1, 1, 2, 50, 50, 5, 5, 0.1)]
    kept = M.suppress(spark.createDataFrame(rows, T + ", score double"), ["image_id"]).collect()
    assert sorted(r["id"] for r in kept) == [0, 2]


def test_star_components_on_a_long_path_and_noise(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (7, 6), (6, 7), (200, 201)]
    got = {r["vertex"]: r["root"] for r in star_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0
