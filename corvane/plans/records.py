"""Queries of projections, filters, validation and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import records as R
from ..session import bounded_values, table
from . import views as V
from .registry import query

C = F.col


def N() -> Column:
    return F.count(F.lit(1))


# The threshold rules of the shared input contract.
RULES = [
    ("maskrcnn", "face", 0.60, 1024, 0.12), ("maskrcnn", "plate", 0.20, 512, 0.12), ("yunet", "*", 0.70, 1024, 0.12),
    ("*", "signature", 0.40, 256, 0.12), ("*", "*", 0.50, 1024, 0.12),
]
_RULES_SQL = ", ".join(str(r) for r in RULES)
_NAMES_SQL = ", ".join(f"({k}, '{v}')" for k, v in V.CLASSES.items())


def rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RULES, "provider string, class_name string, score double, min_area int, max_fraction double")


def class_names(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(V.CLASSES.items()), "class_id int, class_name string")


def named_evidence(s: SparkSession, d: str) -> DataFrame:
    return V.evidence(s, d).join(F.broadcast(class_names(s)), "class_id", "left").withColumn("class_name", F.coalesce("class_name", C("class_id").cast("string")))


_EV = f"WITH {V.EVIDENCE_SQL}, names(class_id, class_name) AS (VALUES {_NAMES_SQL}), ne AS (SELECT e.*, coalesce(n.class_name, e.class_id::VARCHAR) AS class_name FROM evidence e LEFT JOIN names n USING (class_id))"
_RU = f", rules(provider, class_name, score, min_area, max_fraction) AS (VALUES {_RULES_SQL})"
_LOOK = _EV + _RU + """, ranked AS (
  SELECT ne.*, r.score, r.min_area, r.max_fraction, row_number() OVER (PARTITION BY evidence_id ORDER BY (r.provider <> '*')::INT DESC, (r.class_name <> '*')::INT DESC) AS k
  FROM ne JOIN rules r ON r.provider IN (ne.provider, '*') AND r.class_name IN (ne.class_name, '*')), look AS (SELECT * FROM ranked WHERE k = 1)"""


@query("pf1_manifest_rows", f"""WITH {V.INSTANCES_SQL}
SELECT image_id, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS attribute_ids, count(*) AS instance_count FROM instances GROUP BY 1""")
def pf1(s: SparkSession, d: str) -> DataFrame:
    return V.instances(s, d).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set(C("class_id").cast("string"))), ",").alias("attribute_ids"), N().alias("instance_count"))


@query("pf2_available", f"WITH {V.IMAGES_SQL} SELECT image_id, image_path FROM images WHERE image_path IS NOT NULL")
def pf2(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).filter("image_path is not null").select("image_id", "image_path")


@query("pf3_explode_instances", """SELECT row_id, i.instance_id AS instance_id, i.class_id AS class_id, i.attr_id AS attr_id FROM (SELECT row_id, unnest(instances) AS i FROM processed_records)""")
def pf3(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "processed_records").select("row_id", F.explode("instances").alias("i")).select("row_id", "i.instance_id", "i.class_id", "i.attr_id")


@query("pf4_project_class", """SELECT row_id, coalesce(len(list_filter(instances, lambda i: i.class_id = 3)), 0)::INT AS kept,
  coalesce(len(list_filter(instances, lambda i: i.class_id = 3)), 0) = 0 AS negative FROM processed_records""")
def pf4(s: SparkSession, d: str) -> DataFrame:
    df = R.project_class(table(s, d, "processed_records").select("row_id", "instances"), 3)
    kept = F.when(C("instances").isNull(), 0).otherwise(F.size("instances"))
    return df.select("row_id", kept.alias("kept"), C("negative_for_profile").alias("negative"))


_STATUS = """CASE WHEN abs(ln((decoded_width / decoded_height) / (width / height))) <= ln(1 + 0.01::DOUBLE) THEN 'aligned_resize'
  WHEN abs(ln((decoded_width / decoded_height) * (width / height))) <= ln(1 + 0.01::DOUBLE) THEN 'rotation_candidate' ELSE 'geometry_mismatch' END"""
_ROUTED = f"""WITH {V.IMAGES_SQL}, st AS (SELECT *, {_STATUS} AS g FROM images),
routed AS (SELECT *, CASE WHEN image_id % 101 = 0 THEN 'leakage' WHEN image_path IS NULL THEN 'missing' WHEN decoded_width = 700 AND image_id % 2 = 0 THEN 'decode'
  WHEN g <> 'aligned_resize' THEN g ELSE 'keep' END AS status FROM st)"""


def routed(s: SparkSession, d: str) -> DataFrame:
    g = G.geometry_status(C("width"), C("height"), C("decoded_width"), C("decoded_height"))
    status = R.first_true(("leakage", C("image_id") % 101 == 0), ("missing", C("image_path").isNull()), ("decode", (C("decoded_width") == 700) & (C("image_id") % 2 == 0)))
    return V.images(s, d).withColumn("g", g).withColumn("status", F.coalesce(status, F.when(C("g") != "aligned_resize", C("g")), F.lit("keep")))


@query("pf5_first_failure_routing", _ROUTED + " SELECT image_id, split, status FROM routed")
def pf5(s: SparkSession, d: str) -> DataFrame:
    return routed(s, d).select("image_id", "split", "status")


@query("pf6_selection_outcome", f"""WITH {V.INSTANCES_SQL}, c AS (SELECT image_id, count(*) FILTER (class_id <= 3) AS sel, count(*) FILTER (class_id <= 3 AND w * h >= 20000) AS ok FROM instances GROUP BY 1)
SELECT image_id, CASE WHEN sel = 0 THEN 'negative' WHEN ok = 0 THEN 'omit' ELSE 'keep' END AS outcome FROM c""")
def pf6(s: SparkSession, d: str) -> DataFrame:
    sel = C("class_id") <= 3
    c = V.instances(s, d).groupBy("image_id").agg(F.count_if(sel).alias("sel"), F.count_if(sel & (C("w") * C("h") >= 20000)).alias("ok"))
    return c.select("image_id", R.selection_outcome(C("sel"), C("ok")).alias("outcome"))


_AREA = "abs(list_sum(list_transform(range(1, len(p) + 1, 2), lambda k: p[k] * p[(k + 2 - 1) % len(p) + 1] - p[(k + 2 - 1) % len(p)] * p[k + 1])))"


@query("pf7_validate_records", """WITH x AS (SELECT row_id, width, height, image_release, geometry_status, image_path, negative_for_profile, instances,
  CASE WHEN image_release IS DISTINCT FROM 'visual_redactions_v1' THEN 'record_image_release' WHEN geometry_status <> 'aligned_resize' THEN 'record_geometry_is_not_verified'
   WHEN image_path IS NULL OR width IS NULL OR height IS NULL THEN 'missing_or_invalid_required_field' WHEN width < 1 OR height < 1 OR instances IS NULL THEN 'invalid_dimensions_or_instances'
   WHEN len(instances) = 0 AND NOT coalesce(negative_for_profile, false) THEN 'empty_instances_without_negative_marker' END AS r FROM processed_records),
i AS (SELECT row_id, width, height, unnest(instances) AS i, generate_subscripts(instances, 1) AS k FROM x WHERE r IS NULL),
e AS (SELECT row_id, k, CASE
   WHEN i IS NULL OR i.class_id IS NULL OR i.bbox IS NULL OR len(i.bbox) <> 4 OR list_contains(list_transform(i.bbox, lambda v: v IS NULL), true) THEN 'malformed_instance'
   WHEN i.class_id NOT BETWEEN 1 AND 24 THEN 'unknown_class_id'
   WHEN list_contains(list_transform(i.bbox, lambda v: NOT isfinite(v)), true) THEN 'non_finite_bbox'
   WHEN i.bbox[3] <= 0 OR i.bbox[4] <= 0 THEN 'invalid_bbox_area'
   WHEN i.bbox[1] < 0 OR i.bbox[2] < 0 OR i.bbox[1] + i.bbox[3] > width + 0.01::DOUBLE OR i.bbox[2] + i.bbox[4] > height + 0.01::DOUBLE THEN 'bbox_out_of_bounds'
   WHEN i.polygons IS NULL OR len(i.polygons) = 0 THEN 'missing_polygons'
   ELSE coalesce(list_filter(list_transform(i.polygons, lambda p: CASE WHEN p IS NULL OR len(p) < 6 OR len(p) % 2 = 1 THEN 'invalid_polygon_length'
      WHEN list_contains(list_transform(p, lambda v: v IS NULL), true) THEN 'non_numeric_polygon' WHEN list_contains(list_transform(p, lambda v: NOT isfinite(v)), true) THEN 'non_finite_polygon'
      WHEN list_contains(list_transform(p, lambda v, j: v < 0 OR v >= CASE WHEN j % 2 = 1 THEN width ELSE height END), true) THEN 'polygon_out_of_bounds' END), lambda t: t IS NOT NULL)[1],
      CASE WHEN NOT list_contains(list_transform(i.polygons, lambda p: """ + _AREA + """ > 0), true) THEN 'zero_area_polygons' END) END AS err FROM i),
f AS (SELECT row_id, min(k) FILTER (err IS NOT NULL) AS bad, arg_min(err, k) FILTER (err IS NOT NULL) AS err FROM e GROUP BY 1)
SELECT x.row_id, coalesce(x.r, f.err) AS error, (CASE WHEN x.r IS NOT NULL THEN 0 ELSE coalesce(f.bad - 1, len(x.instances)) END)::INT AS sound FROM x LEFT JOIN f USING (row_id)""")
def pf7(s: SparkSession, d: str) -> DataFrame:
    ids = bounded_values(table(s, d, "class_map"), "class_id", R.MAX_RULES)
    return R.validate_records(table(s, d, "processed_records"), ids, "visual_redactions_v1").select("row_id", "error", "sound")


@query("pf7_delivery_errors", """WITH x AS (SELECT row_id, redactions_split AS split, CASE WHEN row_id % 19 = 0 THEN 'train2017' ELSE redactions_split END AS expected, CASE WHEN row_id % 23 = 0 THEN 'val2017' ELSE redactions_split END AS image_split,
  CASE WHEN row_id % 29 = 0 THEN '../' || image_path WHEN row_id % 31 = 0 THEN '/elsewhere/' || image_path ELSE image_path END AS path, image_id FROM processed_records),
k AS (SELECT DISTINCT images.image_id AS image_id FROM same_release_split_leakage_audit)
SELECT row_id, CASE WHEN split IS DISTINCT FROM expected THEN 'record_split_does_not_match_filename' WHEN image_split IS DISTINCT FROM expected THEN 'record_image_split_does_not_match_annotation_split'
  WHEN path LIKE '../%' OR path LIKE '/elsewhere/%' THEN 'image_path_outside_project' WHEN NOT starts_with(path, 'images/' || expected || '/') THEN 'image_path_outside_same_release_split' WHEN path IS NOT NULL AND k.image_id IS NULL THEN 'image_file_missing' END AS error
FROM x LEFT JOIN k USING (image_id)""")
def pf7b(s: SparkSession, d: str) -> DataFrame:
    """Delivery faults of the records; files are those whose image was scanned."""
    k = table(s, d, "same_release_split_leakage_audit").select("images.image_id", F.lit(True).alias("known")).distinct()
    x, split = table(s, d, "processed_records").select("row_id", "image_id", "redactions_split", "image_path").join(k, "image_id", "left"), C("redactions_split")
    path = F.when(C("row_id") % 29 == 0, F.concat(F.lit("../"), "image_path")).when(C("row_id") % 31 == 0, F.concat(F.lit("/elsewhere/"), "image_path")).otherwise(C("image_path"))
    image_split = F.when(C("row_id") % 23 == 0, "val2017").otherwise(split)
    expected = F.when(C("row_id") % 19 == 0, "train2017").otherwise(split)
    return x.select("row_id", R.delivery_errors(split, image_split, expected, path, "/project", "images", F.coalesce("known", F.lit(False))).alias("error"))


@query("pf8_region_contract", f"""WITH {V.EVIDENCE_SQL} SELECT evidence_id, CASE WHEN x0 + w > width - 300 THEN 'outside' WHEN class_id = 4 THEN 'too_few_points' WHEN class_id = 7 THEN 'run_lengths' END AS error FROM evidence""")
def pf8b(s: SparkSession, d: str) -> DataFrame:
    polygon = F.when(C("class_id") == 4, F.array(C("x0"), C("y0"), C("x0"), C("y0") + 1)).otherwise(G.rectangle_polygon(C("x0"), C("y0"), C("w"), C("h")))
    area = C("width") * C("height")
    runs = F.array(F.lit(1), area - 1 - F.when(C("class_id") == 7, 300 * C("height") + 1).otherwise(300 * C("height")))
    box = (C("x0"), C("y0"), C("x0") + C("w"), C("y0") + C("h"))
    return V.evidence(s, d).select("evidence_id", R.geometry_contract(C("width") - 300, C("height"), box, polygon, runs).alias("error"))


@query("pf8_geometry_contract", f"""WITH {V.EVIDENCE_SQL}
SELECT provider, count(*) FILTER (width < 1 OR height < 1) AS bad_size, count(*) FILTER (x0 + w > width OR y0 + h > height) AS outside, count(*) FILTER (w <= 0 OR h <= 0) AS empty_box, count(*) AS n FROM evidence GROUP BY 1""")
def pf8(s: SparkSession, d: str) -> DataFrame:
    outside = (C("x0") + C("w") > C("width")) | (C("y0") + C("h") > C("height"))
    return V.evidence(s, d).groupBy("provider").agg(
        F.count_if((C("width") < 1) | (C("height") < 1)).alias("bad_size"), F.count_if(outside).alias("outside"),
        F.count_if((C("w") <= 0) | (C("h") <= 0)).alias("empty_box"), N().alias("n"))


@query("pf9_evidence_contract", f"""WITH {V.EVIDENCE_SQL}
SELECT class_id, count(*) FILTER (evidence_id IS NULL OR evidence_id = '') AS no_id, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS bad_confidence, count(DISTINCT evidence_id) AS ids FROM evidence GROUP BY 1""")
def pf9(s: SparkSession, d: str) -> DataFrame:
    return V.evidence(s, d).groupBy("class_id").agg(
        F.count_if(F.coalesce(C("evidence_id"), F.lit("")) == "").alias("no_id"), F.count_if(~C("confidence").between(0, 1)).alias("bad_confidence"), F.count_distinct("evidence_id").alias("ids"))


_REASON = "CASE WHEN confidence < score THEN 'score' WHEN w * h < min_area THEN 'min_area' WHEN (w * h) / (width * height)::DOUBLE > max_fraction THEN 'area_fraction' END"


def filtered(s: SparkSession, d: str) -> DataFrame:
    df = R.threshold_lookup(named_evidence(s, d), rules(s))
    return df.withColumn("reason", R.reject_reason(C("confidence"), C("w") * C("h"), C("width") * C("height")))


@query("pf10_threshold_filter", f"{_LOOK} SELECT evidence_id, {_REASON} AS reason FROM look")
def pf10(s: SparkSession, d: str) -> DataFrame:
    return filtered(s, d).select("evidence_id", "reason")


@query("pf11_mandatory", f"{_LOOK} SELECT evidence_id, (max_fraction < 0.2 AND score >= 0.6) OR provider = 'zxingcpp' OR confidence < 0.3 AS mandatory FROM look")
def pf11(s: SparkSession, d: str) -> DataFrame:
    df = R.threshold_lookup(named_evidence(s, d), rules(s))
    return df.select("evidence_id", (((C("max_fraction") < 0.2) & (C("score") >= 0.6)) | (C("provider") == "zxingcpp") | (C("confidence") < 0.3)).alias("mandatory"))


@query("pf12_class_set_overlap", f"""WITH {V.INSTANCES_SQL}, c AS (SELECT image_id, list(DISTINCT class_id) AS cs FROM instances GROUP BY 1),
sel AS (SELECT *, CASE image_id % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [7] ELSE [] END AS sel FROM c) SELECT image_id FROM sel WHERE len(sel) = 0 OR list_has_any(cs, sel)""")
def pf12(s: SparkSession, d: str) -> DataFrame:
    c = V.instances(s, d).groupBy("image_id").agg(F.collect_set("class_id").alias("cs"))
    wanted = F.when(C("image_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(C("image_id") % 3 == 1, F.array(F.lit(7))).otherwise(F.array().cast("array<int>"))
    return c.withColumn("sel", wanted).filter((F.size("sel") == 0) | F.arrays_overlap("cs", "sel")).select("image_id")


@query("pf13_allow_list", f"WITH {V.EVIDENCE_SQL} SELECT evidence_id, class_id FROM evidence WHERE class_id IN (1, 3, 5)")
def pf13(s: SparkSession, d: str) -> DataFrame:
    return V.evidence(s, d).filter(C("class_id").isin(1, 3, 5)).select("evidence_id", "class_id")


@query("pf14_class_threshold", f"WITH {V.EVIDENCE_SQL}, t(class_id, t) AS (VALUES (1, 0.7), (2, 0.4)) SELECT evidence_id FROM evidence LEFT JOIN t USING (class_id) WHERE confidence >= coalesce(t, 0.5)")
def pf14(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([(1, 0.7), (2, 0.4)], "class_id int, t double")
    return V.evidence(s, d).join(F.broadcast(t), "class_id", "left").filter(C("confidence") >= F.coalesce("t", F.lit(0.5))).select("evidence_id")


@query("pf15_no_rule_keeps", f"WITH {V.EVIDENCE_SQL}, t(class_id, t) AS (VALUES (1, 0.7), (2, 0.4)) SELECT evidence_id FROM evidence LEFT JOIN t USING (class_id) WHERE t IS NULL OR confidence >= t")
def pf15(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([(1, 0.7), (2, 0.4)], "class_id int, t double")
    return V.evidence(s, d).join(F.broadcast(t), "class_id", "left").filter(C("t").isNull() | (C("confidence") >= C("t"))).select("evidence_id")


@query("pf16_background_and_unknown", f"WITH {V.EVIDENCE_SQL} SELECT evidence_id, class_id > 6 AS unknown_class FROM evidence WHERE class_id <> 1")
def pf16(s: SparkSession, d: str) -> DataFrame:
    return V.evidence(s, d).filter("class_id <> 1").select("evidence_id", (~C("class_id").isin(*range(2, 7))).alias("unknown_class"))


@query("pf17_label_suffix", """SELECT DISTINCT attr_id, ends_with(attr_id, '_all') AS covered FROM class_map WHERE attr_id IN (SELECT attr_id FROM class_map WHERE family <> 'textual')""")
def pf17(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "class_map")
    return m.join(m.filter("family <> 'textual'").select("attr_id"), "attr_id", "left_semi").select("attr_id", C("attr_id").endswith("_all").alias("covered")).distinct()


@query("pf18_clamp_boxes", f"""WITH {V.INSTANCES_SQL}, b AS (SELECT image_id, instance_id, greatest(x0 - 50, 0) AS l, least(x0 + w + 300, width) AS r, greatest(y0 - 50, 0) AS t, least(y0 + h - 40, height) AS b FROM instances)
SELECT image_id, instance_id, l, t, r, b FROM b WHERE r > l AND b > t""")
def pf18(s: SparkSession, d: str) -> DataFrame:
    df = V.instances(s, d).select(
        "image_id", "instance_id", F.greatest(C("x0") - 50, F.lit(0)).alias("l"), F.greatest(C("y0") - 50, F.lit(0)).alias("t"),
        F.least(C("x0") + C("w") + 300, C("width")).alias("r"), F.least(C("y0") + C("h") - 40, C("height")).alias("b"))
    return df.filter("r > l and b > t")


@query("pf20_scene_crop_flags", f"""WITH {V.IMAGES_SQL} SELECT image_id, least(width, height) >= 600 AND width::DOUBLE / height <= 2.5 AS scene_like, greatest(width, height) < 900 OR width::DOUBLE / height > 2.5 AS crop_like FROM images""")
def pf20(s: SparkSession, d: str) -> DataFrame:
    ratio = C("width") / C("height")
    return V.images(s, d).select("image_id", ((F.least("width", "height") >= 600) & (ratio <= 2.5)).alias("scene_like"), ((F.greatest("width", "height") < 900) | (ratio > 2.5)).alias("crop_like"))


@query("jn8_threshold_lookup", f"{_LOOK} SELECT evidence_id, score, min_area, max_fraction FROM look")
def jn8(s: SparkSession, d: str) -> DataFrame:
    return R.threshold_lookup(named_evidence(s, d), rules(s)).select("evidence_id", "score", "min_area", "max_fraction")


@query("jn14_class_names", f"{_EV} SELECT evidence_id, class_name FROM ne")
def jn14(s: SparkSession, d: str) -> DataFrame:
    return named_evidence(s, d).select("evidence_id", "class_name")
