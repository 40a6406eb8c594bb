"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing as H
from ..session import table
from . import views as V
from .registry import query

C = F.col

def _sizes() -> list[Column]:
    return [C(c) for c in ("width", "height", "decoded_width", "decoded_height")]



@query("fn1_geometry_status", f"""WITH {V.IMAGES_SQL}
SELECT image_id, CASE WHEN abs(ln((decoded_width / decoded_height) / (width / height))) <= ln(1 + 0.01::DOUBLE) THEN 'aligned_resize'
  WHEN abs(ln((decoded_width / decoded_height) * (width / height))) <= ln(1 + 0.01::DOUBLE) THEN 'rotation_candidate'
  ELSE 'geometry_mismatch' END AS status FROM images""")
def fn1(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).select("image_id", G.geometry_status(*_sizes()).alias("status"))


@query("fn2_release_geometry", f"""WITH {V.IMAGES_SQL}
SELECT image_id, CASE WHEN width = decoded_width AND height = decoded_height THEN 'exact' WHEN width = decoded_height AND height = decoded_width THEN 'rotated'
  WHEN abs(width / height - decoded_width / decoded_height) <= 0.01 THEN 'aligned_resize' ELSE 'mismatch' END AS status FROM images""")
def fn2(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).select("image_id", G.release_geometry(*_sizes()).alias("status"))


@query("fn3_scaled_polygon", f"""WITH {V.INSTANCES_SQL}
SELECT image_id, instance_id, round(least(x0 * 1.5, width - 1.0), 3)::DOUBLE AS first_x, round(least((y0 + h) * 1.25, height - 1.0), 3)::DOUBLE AS last_y FROM instances""")
def fn3(s: SparkSession, d: str) -> DataFrame:
    box = G.rectangle_polygon(*(C(c).cast("double") for c in ("x0", "y0", "w", "h")))
    scaled = G.scaled_polygon(box, F.lit(1.5), F.lit(1.25), C("width"), C("height"))
    return V.instances(s, d).select("image_id", "instance_id", scaled.alias("p")).select("image_id", "instance_id", F.get("p", F.lit(0)).alias("first_x"), F.get("p", F.lit(7)).alias("last_y"))


@query("fn4_scaled_bbox", f"""WITH {V.INSTANCES_SQL},
b AS (SELECT *, least(x0 * 1.5::DOUBLE, width - 1.0) AS l, least(y0 * 1.25::DOUBLE, height - 1.0) AS t,
  least((x0 + w) * 1.5::DOUBLE, width) AS r, least((y0 + h) * 1.25::DOUBLE, height) AS b FROM instances)
SELECT image_id, instance_id, round(l, 3) AS x, round(t, 3) AS y, round(greatest(r, l) - l, 3) AS w, round(greatest(b, t) - t, 3) AS h FROM b""")
def fn4(s: SparkSession, d: str) -> DataFrame:
    box = G.scaled_bbox(*(C(c).cast("double") for c in ("x0", "y0", "w", "h")), F.lit(1.5), F.lit(1.25), C("width"), C("height"))
    return V.instances(s, d).select("image_id", "instance_id", box.alias("b")).select("image_id", "instance_id", "b.*")


@query("fn5_polygon_area", f"""WITH {V.INSTANCES_SQL} SELECT image_id, instance_id, (w * h)::DOUBLE AS area FROM instances""")
def fn5(s: SparkSession, d: str) -> DataFrame:
    box = G.rectangle_polygon(*(C(c).cast("double") for c in ("x0", "y0", "w", "h")))
    return V.instances(s, d).select("image_id", "instance_id", G.polygon_area(box).alias("area"))


@query("fn6_source_area", f"""WITH {V.INSTANCES_SQL}
SELECT image_id, instance_id, CASE class_id % 3 WHEN 0 THEN w + h WHEN 1 THEN w ELSE w * h END::DOUBLE AS area FROM instances""")
def fn6(s: SparkSession, d: str) -> DataFrame:
    c = {n: C(n).cast("double") for n in ("x0", "y0", "w", "h")}
    kind = C("class_id") % 3
    area = G.source_area(F.when(kind == 0, F.array(c["w"], c["h"])), F.when(kind == 1, c["w"]), F.array(G.rectangle_polygon(*c.values())))
    return V.instances(s, d).select("image_id", "instance_id", area.alias("area"))


@query("fn7_resized_shape", f"""WITH {V.IMAGES_SQL},
s AS (SELECT image_id, width, height, CASE WHEN greatest(width, height) * (512::DOUBLE / least(width, height)) > 768 THEN 768::DOUBLE / greatest(width, height)
  ELSE 512::DOUBLE / least(width, height) END AS k FROM images)
SELECT image_id, round_even(height * k, 0)::INT AS height, round_even(width * k, 0)::INT AS width FROM s""")
def fn7(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).select("image_id", G.resized_shape(C("height"), C("width"), 512, 768).alias("r")).select("image_id", "r.*")


@query("fn8_size_bucket", f"""WITH {V.INSTANCES_SQL}
SELECT CASE WHEN w * h < 1024 THEN 'small' WHEN w * h < 9216 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM instances GROUP BY 1""")
def fn8(s: SparkSession, d: str) -> DataFrame:
    return V.instances(s, d).groupBy(G.size_bucket(C("w") * C("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("fn9_corners", f"""WITH {V.INSTANCES_SQL} SELECT image_id, instance_id, x0 + w AS x1, y0 + h AS y1 FROM instances""")
def fn9(s: SparkSession, d: str) -> DataFrame:
    _, _, x1, y1 = G.corners(C("x0"), C("y0"), C("w"), C("h"))
    return V.instances(s, d).select("image_id", "instance_id", x1.alias("x1"), y1.alias("y1"))


@query("fn12_rle_spans", f"""WITH {V.INSTANCES_SQL}
SELECT image_id, instance_id, x0 AS start, w AS length FROM instances
UNION ALL SELECT image_id, instance_id, x0 + w + 5 AS start, h AS length FROM instances""")
def fn12(s: SparkSession, d: str) -> DataFrame:
    runs = F.array(C("x0"), C("w"), F.lit(5), C("h"), F.lit(9))
    return V.instances(s, d).select("image_id", "instance_id", F.explode(H.rle_spans(runs, C("width"))).alias("s")).select("image_id", "instance_id", "s.start", "s.length")


@query("fn13_expanded_box", f"""WITH {V.EVIDENCE_SQL}
SELECT evidence_id, greatest(0, floor(x0 - w * 0.05::DOUBLE))::INT AS x0, greatest(0, floor(y0 - h * 0.05::DOUBLE))::INT AS y0,
  least(width, ceil(x0 + w + w * 0.05::DOUBLE))::INT AS x1, least(height, ceil(y0 + h + h * 0.05::DOUBLE))::INT AS y1 FROM evidence""")
def fn13(s: SparkSession, d: str) -> DataFrame:
    box = G.expanded_box(C("x0"), C("y0"), C("x0") + C("w"), C("y0") + C("h"), 0.05, C("width"), C("height"))
    return V.evidence(s, d).select("evidence_id", box.alias("b")).select("evidence_id", "b.*")


_BITS = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
m AS (SELECT vec_id, e, list_median(e[2:64]) AS m FROM x)"""


@query("fn14_hash_lsb", _BITS + """
SELECT vec_id, list_sum(list_transform(range(2, 64), lambda k: CASE WHEN e[k] > m THEN 1::BIGINT << (k - 1)::INT ELSE 0 END))::BIGINT AS low63, e[64] > m AS top FROM m""")
def fn14(s: SparkSession, d: str) -> DataFrame:
    h = H.bits_lsb_first(C("embedding"))
    return table(s, d, "embeddings").select("vec_id", h.alias("h")).select("vec_id", C("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low63"), (C("h") < 0).alias("top"))


@query("fn15_hash_msb", _BITS + """
SELECT vec_id, list_sum(list_transform(range(2, 65), lambda k: CASE WHEN e[k] > m THEN 1::BIGINT << (64 - k)::INT ELSE 0 END))::BIGINT AS low63, e[1] > m AS top FROM m""")
def fn15(s: SparkSession, d: str) -> DataFrame:
    h = H.bits_msb_first(C("embedding"))
    return table(s, d, "embeddings").select("vec_id", h.alias("h")).select("vec_id", C("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low63"), (C("h") < 0).alias("top"))


@query("fn17_hash_parts", f"""WITH {V.HASHES_SQL}
SELECT item_id, h & 2047 AS p0, (h >> 11) & 2047 AS p1, (h >> 22) & 2047 AS p2, (h >> 33) & 2047 AS p3, (h >> 44) & 1023 AS p4, (h >> 54) & 63 AS p5 FROM hashes""")
def fn17(s: SparkSession, d: str) -> DataFrame:
    parts = H.hash_parts(C("h"), (11, 11, 11, 11, 10, 6))
    return V.hashes(s, d).select("item_id", *(p.alias(f"p{i}") for i, p in enumerate(parts)))


@query("fn18_hamming", """WITH a AS (SELECT DISTINCT record_id, phash FROM audit_yolo_detection_dataset)
SELECT m.match_id, bit_count(xor(l.phash, r.phash))::INT AS distance FROM phash_matches m JOIN a l ON l.record_id = m.left_record_id JOIN a r ON r.record_id = m.right_record_id""")
def fn18(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").select("record_id", "phash").distinct()
    m = table(s, d, "phash_matches").select("match_id", "left_record_id", "right_record_id")
    m = m.join(a.toDF("left_record_id", "g"), "left_record_id").join(a.toDF("right_record_id", "h"), "right_record_id")
    return m.select("match_id", H.hamming(C("g"), C("h")).alias("distance"))


@query("fn19_entropy", """WITH c AS (SELECT source_split, annotation_qa, count(*) AS n FROM audit_yolo_detection_dataset GROUP BY ALL),
t AS (SELECT source_split, n / sum(n) OVER (PARTITION BY source_split) AS p FROM c)
SELECT source_split, round(-sum(p * log2(p)), 9) AS bits FROM t GROUP BY 1""")
def fn19(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "audit_yolo_detection_dataset").groupBy("source_split", "annotation_qa").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy("source_split").agg(F.array_sort(F.collect_list("n")).alias("a")).select("source_split", F.round(H.entropy_bits(C("a")), 9).alias("bits"))


@query("fn20_asset_keys", r"""WITH k AS (SELECT DISTINCT record_id, image_path, regexp_replace(lower(parse_filename(image_path, true)), '\.rf\.[0-9a-f]{16,}$|^[0-9a-f-]{36}___', '', 'g') AS stem FROM audit_yolo_detection_dataset),
n AS (SELECT record_id, array_to_string(regexp_extract_all(stem, '[a-z0-9]+'), '-') AS asset FROM k)
SELECT record_id, asset, CASE WHEN regexp_matches(asset, '^video-?\d+-\d+(-jpg)?$') THEN regexp_extract(asset, '^(video-?\d+)-', 1)
  ELSE regexp_extract(asset, '^(.*?)-?\b(?:(?:mp4|mov|avi)-?t|frame)-?[0-9]', 1) END AS video FROM n""")
def fn20(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "audit_yolo_detection_dataset").select("record_id", "image_path").distinct()
    return df.select("record_id", H.asset_key(C("image_path")).alias("asset"), H.video_group(C("image_path")).alias("video"))


@query("fn21_hash_rank", "SELECT p_partkey, sha256('7:' || p_partkey) AS rank FROM part")
def fn21(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", H.hash_rank(7, C("p_partkey").cast("string")).alias("rank"))


@query("fn22_stable_id", """SELECT o_orderkey, substr(sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}'), 1, 20) AS id FROM orders""")
def fn22(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", H.stable_id(status=C("o_orderstatus"), order=C("o_orderkey"), customer=C("o_custkey")).alias("id"))


@query("fn25_finite_number", """SELECT raw_id, CASE WHEN isfinite(n) THEN n END AS n FROM (
  SELECT raw_id, TRY_CAST(split_part(raw, ',', 2) AS DOUBLE) AS n FROM yolo_label_export)""")
def fn25(s: SparkSession, d: str) -> DataFrame:
    cell = F.split_part(C("raw"), F.lit(","), F.lit(2))
    return table(s, d, "yolo_label_export").select("raw_id", H.finite_number(cell).alias("n"))


@query("fn26_valid_interval", """SELECT l_linenumber, count(*) FILTER (l_discount <= l_tax AND l_tax <= 0.06) AS valid, count(*) AS n FROM lineitem GROUP BY 1""")
def fn26(s: SparkSession, d: str) -> DataFrame:
    ok = H.valid_interval(C("l_discount"), C("l_tax"), F.lit(0.06))
    return table(s, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(ok).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("fn27_tile_plan", f"""WITH RECURSIVE {V.IMAGES_SQL},
grow AS (SELECT image_id, width, height, 512 AS tile FROM images WHERE greatest(width, height) >= 1024
  UNION ALL SELECT image_id, width, height, (tile * 1.5)::DOUBLE::BIGINT AS tile FROM (SELECT *, (floor(tile * 1.5))::BIGINT AS nt,
    (CASE WHEN width <= tile THEN 1 ELSE ceil((width - tile) / round_even(tile * 0.75, 0)) + 1 END) * (CASE WHEN height <= tile THEN 1 ELSE ceil((height - tile) / round_even(tile * 0.75, 0)) + 1 END) AS n FROM grow)
  WHERE n > 6 AND tile < greatest(width, height)),
last AS (SELECT image_id, width, height, max(tile) AS tile FROM grow GROUP BY ALL),
n AS (SELECT image_id, tile, CASE WHEN width <= tile THEN 1 ELSE ceil((width - tile) / round_even(tile * 0.75, 0)) + 1 END AS nx,
  CASE WHEN height <= tile THEN 1 ELSE ceil((height - tile) / round_even(tile * 0.75, 0)) + 1 END AS ny FROM last)
SELECT i.image_id, (CASE WHEN coalesce(nx * ny, 0) <= 1 THEN 0 ELSE nx * ny END)::INT AS tiles FROM images i LEFT JOIN n USING (image_id)""")
def fn27(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).select("image_id", F.size(G.tile_plan(C("width"), C("height"), 512, 0.25, 1024, 6)).alias("tiles"))


@query("fn28_tile_to_image", f"""WITH {V.INSTANCES_SQL}
SELECT image_id, instance_id, least(width, x0 + 300) AS x0, least(height, y0 + 200) AS y0, least(width, x0 + w + 300) AS x1, least(height, y0 + h + 200) AS y1
FROM instances WHERE x0 + 300 < width AND y0 + 200 < height""")
def fn28(s: SparkSession, d: str) -> DataFrame:
    box = G.tile_to_image(G.corners(C("x0"), C("y0"), C("w"), C("h")), F.lit(300), F.lit(200), C("width"), C("height"))
    return V.instances(s, d).select("image_id", "instance_id", box.alias("b")).filter("b is not null").select("image_id", "instance_id", "b.*")


@query("fn31_rectangle_polygon", f"""WITH {V.INSTANCES_SQL} SELECT image_id, instance_id, 2 * x0 + 2 * (x0 + w) + 2 * y0 + 2 * (y0 + h) AS coordinate_sum FROM instances""")
def fn31(s: SparkSession, d: str) -> DataFrame:
    p = G.rectangle_polygon(C("x0"), C("y0"), C("w"), C("h"))
    return V.instances(s, d).select("image_id", "instance_id", F.aggregate(p, F.lit(0), lambda a, b: a + b).alias("coordinate_sum"))


@query("fn11_mask_iou", f"""WITH {V.INSTANCES_SQL}, m AS (SELECT image_id, instance_id, w, h FROM instances)
SELECT image_id, instance_id, round(least(w, h) / greatest(w, h)::DOUBLE, 9) AS iou FROM m""")
def fn11(s: SparkSession, d: str) -> DataFrame:
    mask = lambda n: F.array(F.lit(5), n, F.lit(1000) - n)
    return V.instances(s, d).select("image_id", "instance_id", F.round(H.mask_iou(mask(C("w")), mask(C("h"))), 9).alias("iou"))


@query("fn16_difference_hash", """WITH e AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS v FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda k: v[(k // 8) * 9 + k % 8 + 2] > v[(k // 8) * 9 + k % 8 + 1]) AS b FROM e)
SELECT vec_id, list_sum(list_transform(range(1, 64), lambda k: CASE WHEN b[k + 1] THEN 1::BIGINT << (63 - k)::INT ELSE 0 END))::BIGINT AS low63, b[1] AS top FROM b""")
def fn16(s: SparkSession, d: str) -> DataFrame:
    # 72 values, a grid of 8 x 9: the 64 of the vector and its first eight again
    h = H.difference_hash(F.concat("embedding", F.slice("embedding", 1, 8)))
    return table(s, d, "embeddings").select("vec_id", h.alias("h")).select("vec_id", C("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low63"), (C("h") < 0).alias("top"))


@query("fn24_pixel_digest", """SELECT p_partkey, sha256(unhex(lpad(hex(chr(length(p_name)::INT)), 2, '0') || '00000000000000' || '0100000000000000')::BLOB || encode(p_name)) AS digest FROM part""")
def fn24(s: SparkSession, d: str) -> DataFrame:
    pixels = F.encode("p_name", "utf-8")
    return table(s, d, "part").select("p_partkey", H.pixel_digest(F.octet_length(pixels), F.lit(1), pixels).alias("digest"))


_GRID = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: (floor(abs(e::DOUBLE) * 1000) % 256)::DOUBLE) AS g FROM embeddings)"""


@query("fn33_image_quality", _GRID + """,
m AS (SELECT vec_id, g, list_transform(range(0, 10), lambda k: CASE k WHEN 0 THEN 1 WHEN 9 THEN 6 ELSE k - 1 END) AS p FROM v),
l AS (SELECT vec_id, g, list_transform(range(0, 64), lambda k: g[p[k // 8 + 1] * 8 + k % 8 + 1] + g[p[k // 8 + 3] * 8 + k % 8 + 1] + g[(k // 8) * 8 + p[k % 8 + 1] + 1] + g[(k // 8) * 8 + p[k % 8 + 3] + 1] - 4 * g[k + 1]) AS lap,
  list_transform(range(0, 64), lambda k: sqrt(pow(g[(k // 8) * 8 + p[k % 8 + 3] + 1] - g[(k // 8) * 8 + p[k % 8 + 1] + 1], 2) + pow(g[p[k // 8 + 3] * 8 + k % 8 + 1] - g[p[k // 8 + 1] * 8 + k % 8 + 1], 2))) AS grad FROM m)
SELECT vec_id, round(list_avg(g), 6) AS brightness, round(list_stddev_pop(g), 6) AS contrast, len(list_filter(g, lambda x: x < 32)) / 64::DOUBLE AS dark, len(list_filter(g, lambda x: x > 223)) / 64::DOUBLE AS bright,
  round(list_var_pop(lap), 6) AS laplacian_variance, len(list_filter(grad, lambda x: x > 100)) / 64::DOUBLE AS edge_density FROM l""")
def fn33(s: SparkSession, d: str) -> DataFrame:
    grey = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("double"))
    q = table(s, d, "embeddings").select("vec_id", H.brightness_contrast(grey).alias("q"), H.sharpness(grey, F.lit(8), F.lit(100.0)).alias("e"))
    return q.select(
        "vec_id", F.round("q.brightness", 6).alias("brightness"), F.round("q.contrast", 6).alias("contrast"), C("q.dark").alias("dark"), C("q.bright").alias("bright"),
        F.round("e.laplacian_variance", 6).alias("laplacian_variance"), C("e.edge_density").alias("edge_density"))


@query("fn14_frequency_hash")
def fn14b(s: SparkSession, d: str) -> DataFrame:
    """The hash of a 32 x 32 grey grid, each value the sum of two of the vector's."""
    e = lambda k: F.get("embedding", k).cast("double")
    grid = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: e(F.floor(k / 32).cast("int")) * 100 + e(32 + k % 32) * 37 + e(k % 64))
    low = H.low_frequencies(grid)
    return table(s, d, "embeddings").select("vec_id", low.alias("f")).select("vec_id", H.bits_lsb_first(C("f")).alias("lsb"), H.bits_msb_first(C("f")).alias("msb"))


@query("fn29_output_suffix", """SELECT p_partkey, CASE upper(f) WHEN 'JPEG' THEN '.jpg' WHEN 'PNG' THEN '.png' WHEN 'WEBP' THEN '.webp' ELSE '.png' END AS suffix
FROM (SELECT p_partkey, (['JPEG', 'png', 'WebP', 'MPO', NULL])[1 + p_size % 5] AS f FROM part)""")
def fn29(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("JPEG", "png", "WebP", "MPO", None)))
    return table(s, d, "part").select("p_partkey", H.output_suffix(F.get(kinds, C("p_size") % 5)).alias("suffix"))
