"""Queries that take every row, against brute force over the same tables; none of them may stop at a part of its input."""

import hashlib
import re

import numpy as np

from corvane.operators.similarity import near_images_across_splits
from corvane.plans import registry
from corvane.plans import views as V
from corvane.plans.profile import sampler_weights

QUERIES = registry.queries()


def boxes(spark, data):
    return V.instances(spark, data).select("image_id", "instance_id", "x0", "w", "h", "width").collect()


def drawn(text):
    """The 48 bits of a digest that stand for a uniform draw."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def test_bootstrap_takes_every_row_a_thousand_times(spark, data):
    rows = sorted((r["p_partkey"], float(r["p_retailprice"])) for r in spark.read.parquet(f"{data}/part.parquet").collect())
    x = np.array([v for _, v in rows])
    means = [x[[drawn(f"1337:{b}:{j}") % len(x) for j in range(len(x))]].mean() for b in range(1000)]
    got = QUERIES["ag18_bootstrap_interval"](spark, data).first()
    assert np.allclose([got["lower_95"], got["upper_95"]], np.quantile(means, [0.025, 0.975]), atol=2e-6)


def test_mask_iou_of_every_instance(spark, data):
    rows = boxes(spark, data)
    got = {(r["image_id"], r["instance_id"]): r["iou"] for r in QUERIES["fn11_mask_iou"](spark, data).collect()}
    assert len(got) == len(rows) == spark.read.parquet(f"{data}/lineitem.parquet").count() and max(k for _, k in got) > 2
    for r in rows:
        a, b = (np.repeat([0, 1, 0], [5, n, 1000 - n]) == 1 for n in (r["w"], r["h"]))
        assert abs(got[r["image_id"], r["instance_id"]] - (a & b).sum() / (a | b).sum()) < 1e-8


def test_rle_spans_of_every_instance(spark, data):
    rows = boxes(spark, data)
    assert max(r["instance_id"] for r in rows) > 2
    want = []
    for r in rows:
        flat = np.repeat([0, 1, 0, 1, 0], [r["x0"], r["w"], 5, r["h"], 9])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flat, [0]])))
        want += [(r["image_id"], r["instance_id"], int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]
    assert sorted(tuple(r) for r in QUERIES["fn12_rle_spans"](spark, data).collect()) == sorted(want)


def near_pairs(rows, d=5):
    """All pairs of (image_id, split, sha256, hash) rows of different splits, the lesser split on the left."""
    return {(a[0], a[1], b[0], b[1], a[3], b[3], k) for a in rows for b in rows if a[1] and b[1] and a[1] < b[1] and a[3] is not None and b[3] is not None
            and (k := ((a[3] ^ b[3]) & (2**64 - 1)).bit_count()) <= d and not (a[2] and a[2] == b[2])}


def test_near_images_of_all_splits(spark, data):
    def sha(text):
        m = re.fullmatch("(?:sha256:)?([0-9a-f]{64})", (text or "").strip().lower())
        return m and m[1]

    data = data.replace("sf0.001", "sf0.01")  # the smallest tables have no pair with test2017
    scans = spark.read.parquet(f"{data}/same_release_split_leakage_audit.parquet").select("images.image_id", "images.split", "sha256", "phash").collect()
    want = near_pairs([(i, (sp or "").strip(" ").lower(), sha(c), h) for i, sp, c, h in scans])
    got = [tuple(r) for r in QUERIES["jn5_near_hashes"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {"test2017", "val2017"} <= {s for r in got for s in (r[1], r[3])}


def test_near_images_leave_out_equal_contents(spark):
    rows = [("a", "train", "c1", 0), ("b", "val", "c1", 0), ("c", "test", "c2", 31), ("d", "val", None, 1), ("e", "train", None, 1), ("f", "val", "c3", -1), ("g", "test", "c3", -2), ("h", "test", "c4", -33),
            ("i", "test", "c5", None), ("j", None, "c6", 0), ("a", "val", "c1", 0), ("a", "train", "c7", 0)]
    got = [tuple(r) for r in near_images_across_splits(spark.createDataFrame(rows, "image_id string, split string, sha256 string, h bigint"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == near_pairs(rows)


def test_weighted_draw_is_as_long_as_the_images(spark, data):
    w = sorted((r["image_id"], r["weight"]) for r in sampler_weights(spark, data).collect())
    hi = np.cumsum([x for _, x in w])
    got = {r["draw"]: r["image_id"] for r in QUERIES["sm1_weighted_draw"](spark, data).collect()}
    assert len(w) == len(got) == V.images(spark, data).filter("split = 'train2017'").count()
    assert got == {j: w[np.searchsorted(hi, drawn(f"11:{j}") / 2**48 * hi[-1], "right")][0] for j in range(len(w))}
