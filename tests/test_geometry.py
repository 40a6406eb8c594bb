"""Literal vectors of the shared input contract."""

from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import hashing as H


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_geometry_status(spark):
    lits = lambda *v: [F.lit(x) for x in v]
    r = one(spark, *(G.geometry_status(*lits(*v)) for v in ((3000, 2000, 900, 600), (3000, 2000, 600, 900), (1552, 2592, 640, 640), (0, 1, 1, 1))))
    assert list(r) == ["aligned_resize", "rotation_candidate", "geometry_mismatch", None]


def test_resized_shape(spark):
    r = one(spark, G.resized_shape(F.lit(100), F.lit(160), 64, 96))
    assert tuple(r[0]) == (60, 96)


def test_tiles(spark):
    r = one(
        spark, G.tile_origins(F.lit(1000), F.lit(400), F.lit(300)), G.tile_plan(F.lit(640), F.lit(480)), F.size(G.tile_plan(F.lit(4000), F.lit(3000), max_tiles=6)),
        G.tile_plan(F.lit(1024), F.lit(1024), 512, 0.0),
    )
    assert r[0][0] == 0 and r[0][-1] == 600 and max(b - a for a, b in zip(r[0], r[0][1:])) <= 300
    assert r[1] == [] and 1 < r[2] <= 6
    assert [(t["x0"], t["y0"]) for t in r[3]] == [(0, 0), (512, 0), (0, 512), (512, 512)]


def test_asset_keys(spark):
    names = ["video12-0042.jpg", "road.mp4-t-12_frame-8.rf.0123456789abcdef0.jpg", "independent-still.jpg"]
    r = one(spark, *(H.video_group(F.lit(n)) for n in names))
    assert list(r) == ["video12", "road", ""]


def test_rle_round_trip(spark):
    masks = [[1] * 12, [0] * 12, [0, 1] * 6, []]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, m array<int>")
    rows = df.select("i", "m", H.rle_decode(H.rle_encode("m")).alias("back")).collect()
    assert all(r["m"] == r["back"] for r in rows)


def test_hash_top_bit(spark):
    r = one(spark, H.hamming(F.lit(-1), F.lit(0)), H.hex_hash(F.lit(-1)), *H.hash_parts(F.lit(-1), (11, 53)))
    assert list(r) == [64, "f" * 16, 2047, (1 << 53) - 1]


def test_area_and_iou(spark):
    square = F.array(*(F.lit(float(v)) for v in (0, 0, 4, 0, 4, 4, 0, 4)))
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(spark, G.polygon_area(square), G.box_iou(box(0, 0, 4, 4), box(2, 0, 6, 4)), G.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), G.scaled_polygon(F.array(F.lit(1.0)), F.lit(1.0), F.lit(1.0), F.lit(5), F.lit(5)))
    assert r[0] == 16.0 and abs(r[1] - 1 / 3) < 1e-12 and r[2] == 0.0 and r[3] is None
