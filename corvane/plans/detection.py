"""Queries of matching, metrics, coverage, fusion and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.ordering import running_totals
from . import records as P
from . import views as V
from .records import N
from .registry import query

C = F.col
KEYS = ["image_id", "class_id"]


def truths(s: SparkSession, d: str) -> DataFrame:
    return V.instances(s, d).select("image_id", "class_id", "split", C("instance_id").alias("id"), "x0", "y0", "w", "h")


def detections(s: SparkSession, d: str) -> DataFrame:
    return V.evidence(s, d).select("image_id", "class_id", "split", "provider", C("evidence_id").alias("id"), C("confidence").alias("score"), "x0", "y0", "w", "h")


def _sided(df: DataFrame, p: str, *more: str) -> DataFrame:
    return df.select("image_id", "class_id", *more, *(C(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "w", "h")))


_IOU = "(greatest(least(a.x0+a.w, b.x0+b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0+a.h, b.y0+b.h) - greatest(a.y0, b.y0), 0))"
_PAIRS = f"""WITH {V.EVIDENCE_SQL}, pairs AS (SELECT a.image_id, a.class_id, a.instance_id AS t_id, b.evidence_id AS d_id, {_IOU} / (a.w * a.h + b.w * b.h - {_IOU})::DOUBLE AS iou
  FROM instances a JOIN evidence b ON a.image_id = b.image_id AND a.class_id = b.class_id)"""


def pairs(s: SparkSession, d: str) -> DataFrame:
    return M.iou_pairs(_sided(truths(s, d), "t_"), _sided(detections(s, d), "d_"), KEYS)


@query("jn9_spatial_overlap", f"""WITH {V.EVIDENCE_SQL} SELECT a.image_id, a.evidence_id AS left_id, b.evidence_id AS right_id FROM evidence a JOIN evidence b ON a.image_id = b.image_id AND a.evidence_id < b.evidence_id
 AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h""")
def jn9(s: SparkSession, d: str) -> DataFrame:
    e = detections(s, d)
    p = M.iou_pairs(_sided(e, "t_").drop("class_id"), _sided(e, "d_").drop("class_id"), ["image_id"])
    return p.filter("t_id < d_id").select("image_id", C("t_id").alias("left_id"), C("d_id").alias("right_id"))


@query("jn10_iou_pairs", _PAIRS + " SELECT image_id, t_id, d_id, round(iou, 9) AS iou FROM pairs WHERE iou > 0")
def jn10(s: SparkSession, d: str) -> DataFrame:
    return pairs(s, d).select("image_id", "t_id", "d_id", F.round("iou", 9).alias("iou"))


@query("jn11_best_iou", _PAIRS + " SELECT i.image_id, i.instance_id AS t_id, round(coalesce(max(iou), 0), 9) AS best FROM instances i LEFT JOIN pairs p ON p.image_id = i.image_id AND p.class_id = i.class_id AND p.t_id = i.instance_id GROUP BY 1, 2")
def jn11(s: SparkSession, d: str) -> DataFrame:
    best = pairs(s, d).groupBy("image_id", "t_id").agg(F.max("iou").alias("best"))
    return truths(s, d).select("image_id", C("id").alias("t_id")).join(best, ["image_id", "t_id"], "left").select("image_id", "t_id", F.round(F.coalesce("best", F.lit(0.0)), 9).alias("best"))


def counts(s: SparkSession, d: str, thresholds: list[float]) -> DataFrame:
    return M.match_counts(truths(s, d), detections(s, d), KEYS, thresholds)


# Detections in score order, each taking the free truth of greatest IoU: a fold, with what is taken as its state.
_GREEDY = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
near AS (SELECT image_id, class_id, d_id, list(t_id ORDER BY iou DESC, t_id) AS c FROM pairs WHERE iou >= 0.5 GROUP BY ALL),
dc AS (SELECT e.image_id, e.class_id, e.evidence_id, e.confidence, coalesce(c, []::INT[]) AS c, row_number() OVER (PARTITION BY e.image_id, e.class_id ORDER BY confidence DESC, evidence_id) AS k
  FROM evidence e LEFT JOIN near n ON n.image_id = e.image_id AND n.class_id = e.class_id AND n.d_id = e.evidence_id),
r AS (SELECT image_id, class_id, k, c[1:1] AS taken, len(c) > 0 AS hit FROM dc WHERE k = 1
  UNION ALL SELECT image_id, class_id, k, list_concat(taken, f), len(f) > 0 FROM (SELECT dc.image_id, dc.class_id, dc.k, r.taken, list_filter(dc.c, lambda x: NOT list_contains(r.taken, x))[1:1] AS f
    FROM r JOIN dc ON dc.image_id = r.image_id AND dc.class_id = r.class_id AND dc.k = r.k + 1)),
hits AS (SELECT image_id, class_id, confidence, hit FROM r JOIN dc USING (image_id, class_id, k)),
g AS (SELECT image_id, class_id FROM instances UNION SELECT image_id, class_id FROM evidence), tn AS (SELECT image_id, class_id, count(*) AS t FROM instances GROUP BY ALL),
m AS (SELECT g.image_id, g.class_id, 0.5::DOUBLE AS threshold, coalesce(tp, 0)::INT AS tp, (coalesce(n, 0) - coalesce(tp, 0))::INT AS fp, (coalesce(t, 0) - coalesce(tp, 0))::INT AS fn
  FROM g LEFT JOIN (SELECT image_id, class_id, count(*) AS n, count(*) FILTER (hit) AS tp FROM hits WHERE confidence >= 0.5 GROUP BY ALL) USING (image_id, class_id) LEFT JOIN tn USING (image_id, class_id))"""


@query("wn3_greedy_matching", _GREEDY + " SELECT * FROM m WHERE tp + fp + fn > 0")
def wn3(s: SparkSession, d: str) -> DataFrame:
    return counts(s, d, [0.5]).filter("tp + fp + fn > 0")


_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE {empty} END AS recall"


@query("ag9_match_metrics", _GREEDY + f""", s AS (SELECT class_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m GROUP BY 1), pr AS (SELECT *, {_PR.format(empty=0)} FROM s)
SELECT *, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM pr""")
def ag9(s: SparkSession, d: str) -> DataFrame:
    return M.precision_recall(counts(s, d, [0.5]), ["class_id"]).drop("f1")


@query("ag10_detection_metrics", _GREEDY + f""", s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m), pr AS (SELECT *, {_PR.format(empty=1)} FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, fp / (SELECT count(*) FROM images)::DOUBLE AS fp_per_image FROM pr""")
def ag10(s: SparkSession, d: str) -> DataFrame:
    m = M.precision_recall(counts(s, d, [0.5]).withColumn("one", F.lit("all")), ["one"], empty_recall=1.0).drop("f2", "one")
    return m.withColumn("fp_per_image", C("fp") / V.images(s, d).count())


@query("ag27_threshold_calibration", _GREEDY + f""", th AS (SELECT round(0.05::DOUBLE * k, 2) AS threshold FROM range(1, 20) x(k)), c AS (SELECT class_id, count(*) AS t FROM instances GROUP BY 1),
s AS (SELECT class_id, threshold, count(*) FILTER (hit AND confidence >= threshold) AS tp, count(*) FILTER (NOT hit AND confidence >= threshold) AS fp, any_value(t) - count(*) FILTER (hit AND confidence >= threshold) AS fn FROM hits JOIN c USING (class_id), th GROUP BY 1, 2),
pr AS (SELECT *, {_PR.format(empty=0)} FROM s), f AS (SELECT *, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM pr),
o AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY f2 DESC, threshold) AS k FROM f)
SELECT class_id, coalesce(max(threshold) FILTER (recall >= 0.3 AND precision >= 0.5), max(threshold) FILTER (k = 1)) AS selected, CASE WHEN count(*) FILTER (recall >= 0.3 AND precision >= 0.5) > 0 THEN 'floors_met' ELSE 'max_f2_fallback' END AS reason FROM o GROUP BY 1""")
def ag27(s: SparkSession, d: str) -> DataFrame:
    grid = [round(0.05 * k, 2) for k in range(1, 20)]
    m = M.precision_recall(counts(s, d, grid), ["class_id", "threshold"])
    return M.choose_thresholds(m, "class_id", 0.3, 0.5)


@query("ag11_coco_statistics")
def ag11(s: SparkSession, d: str) -> DataFrame:
    return M.coco_statistics(truths(s, d), detections(s, d))


@query("wn4_precision_envelope", f"""WITH {V.EVIDENCE_SQL}, o AS (SELECT class_id, evidence_id, confidence, (w * h >= 9216)::INT AS tp FROM evidence),
r AS (SELECT *, sum(tp) OVER w AS ctp, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY class_id ORDER BY confidence DESC, evidence_id ROWS UNBOUNDED PRECEDING))
SELECT evidence_id, class_id, ctp::BIGINT AS ctp, round(ctp / n::DOUBLE, 9) AS precision FROM r""")
def wn4(s: SparkSession, d: str) -> DataFrame:
    o = V.evidence(s, d).select("class_id", "evidence_id", "confidence", (C("w") * C("h") >= 9216).cast("int").alias("tp"), F.lit(1).alias("one"))
    r = running_totals(o, "class_id", [F.desc("confidence"), C("evidence_id")], {"ctp": "tp", "n": "one"})
    return r.select("evidence_id", "class_id", "ctp", F.round(C("ctp") / C("n"), 9).alias("precision"))


@query("wn5_top_detections", f"WITH {V.EVIDENCE_SQL} SELECT image_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, evidence_id) AS k FROM evidence) WHERE k <= 100")
def wn5(s: SparkSession, d: str) -> DataFrame:
    return M.top_per_group(V.evidence(s, d), ["image_id"], [F.desc("confidence"), C("evidence_id")], 100).select("image_id", "evidence_id")


@query("so6_best_detection", f"WITH {V.EVIDENCE_SQL} SELECT image_id, arg_max(evidence_id, confidence * 1000000 - right(evidence_id, 1)::INT) AS best, max(confidence) AS confidence FROM evidence GROUP BY 1")
def so6(s: SparkSession, d: str) -> DataFrame:
    key = C("confidence") * 1000000 - F.right("evidence_id", F.lit(1)).cast("int")
    return V.evidence(s, d).groupBy("image_id").agg(F.max_by("evidence_id", key).alias("best"), F.max("confidence").alias("confidence"))


@query("so7_suppression", f"""WITH RECURSIVE {V.EVIDENCE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, evidence_id) AS k FROM evidence),
c AS (SELECT b.image_id, b.k, list(a.k) AS c FROM o a JOIN o b ON a.image_id = b.image_id AND a.k < b.k AND {_IOU} / (a.w * a.h + b.w * b.h - {_IOU})::DOUBLE > 0.3 GROUP BY ALL),
oc AS (SELECT o.image_id, o.evidence_id, o.k, coalesce(c, []::BIGINT[]) AS c FROM o LEFT JOIN c USING (image_id, k)),
r AS (SELECT image_id, k, [k] AS kept, true AS keep FROM oc WHERE k = 1
  UNION ALL SELECT image_id, k, CASE WHEN ok THEN list_append(kept, k) ELSE kept END, ok FROM (SELECT oc.image_id, oc.k, r.kept, len(r.kept) < 750 AND oc.k <= 5000 AND NOT list_has_any(r.kept, oc.c) AS ok FROM r JOIN oc ON oc.image_id = r.image_id AND oc.k = r.k + 1))
SELECT image_id, evidence_id FROM r JOIN oc USING (image_id, k) WHERE keep""")
def so7(s: SparkSession, d: str) -> DataFrame:
    return M.suppress(detections(s, d), ["image_id"]).select("image_id", C("id").alias("evidence_id"))


def covered(s: SparkSession, d: str) -> DataFrame:
    return M.coverage(truths(s, d), detections(s, d).filter("score >= 0.5"), KEYS)


_CELLS = f"""WITH {V.EVIDENCE_SQL}, e AS (SELECT * FROM evidence WHERE confidence >= 0.5),
b AS (SELECT image_id, class_id, x0, x0 + w AS x1, y0, y0 + h AS y1, true AS t FROM instances UNION ALL SELECT image_id, class_id, x0, x0 + w, y0, y0 + h, false FROM e),
ex AS (SELECT image_id, class_id, x AS a, lead(x) OVER (PARTITION BY image_id, class_id ORDER BY x) AS b FROM (SELECT image_id, class_id, x0 AS x FROM b UNION SELECT image_id, class_id, x1 FROM b)),
ey AS (SELECT image_id, class_id, y AS a, lead(y) OVER (PARTITION BY image_id, class_id ORDER BY y) AS b FROM (SELECT image_id, class_id, y0 AS y FROM b UNION SELECT image_id, class_id, y1 FROM b)),
cell AS (SELECT ex.image_id, ex.class_id, ex.a, ey.a AS c, (ex.b - ex.a) * (ey.b - ey.a) AS area FROM ex JOIN ey USING (image_id, class_id) WHERE ex.b IS NOT NULL AND ey.b IS NOT NULL),
hit AS (SELECT cell.*, bool_or(b.t) AS t, bool_or(NOT b.t) AS d FROM cell JOIN b ON b.image_id = cell.image_id AND b.class_id = cell.class_id AND b.x0 <= cell.a AND cell.a < b.x1 AND b.y0 <= cell.c AND cell.c < b.y1 GROUP BY ALL),
cov AS (SELECT image_id, class_id, coalesce(sum(area) FILTER (t), 0)::DOUBLE AS truth_area, coalesce(sum(area) FILTER (t AND d), 0)::DOUBLE AS covered_area, coalesce(sum(area) FILTER (d AND NOT t), 0)::DOUBLE AS extra_area FROM hit GROUP BY 1, 2)"""


@query("ag12_coverage", _CELLS + " SELECT image_id, class_id, truth_area, covered_area, extra_area FROM cov")
def ag12(s: SparkSession, d: str) -> DataFrame:
    return covered(s, d).select(*KEYS, "truth_area", "covered_area", "extra_area")


@query("ag12_covered_instances", _CELLS + """, per AS (SELECT t.image_id, t.class_id, t.instance_id, any_value(t.w * t.h) AS size, coalesce(sum(hit.area) FILTER (hit.d), 0) AS cov FROM instances t JOIN hit ON hit.image_id = t.image_id AND hit.class_id = t.class_id
  AND t.x0 <= hit.a AND hit.a < t.x0 + t.w AND t.y0 <= hit.c AND hit.c < t.y0 + t.h GROUP BY ALL)
SELECT image_id, class_id, count(*)::INT AS truths, count(*) FILTER (cov >= 0.8::DOUBLE * size)::INT AS covered_truths FROM per GROUP BY ALL""")
def ag12b(s: SparkSession, d: str) -> DataFrame:
    return covered(s, d).filter("truths > 0").select(*KEYS, "truths", "covered_truths")


@query("ag13_overall_scorecard", _CELLS + """, im AS (SELECT i.image_id, coalesce(sum(truth_area), 0) AS t, coalesce(sum(covered_area), 0) AS c FROM images i LEFT JOIN cov USING (image_id) GROUP BY 1)
SELECT count(*) AS images, round(sum(c) / sum(t), 9) AS micro_recall, round(avg(CASE WHEN t > 0 THEN c / t ELSE 1 END), 9) AS macro_recall FROM im""")
def ag13c(s: SparkSession, d: str) -> DataFrame:
    """Over all images: recall of all pixels, and the mean of the images' own recall, 1 where there is nothing to cover."""
    per = covered(s, d).groupBy("image_id").agg(F.sum("truth_area").alias("t"), F.sum("covered_area").alias("c"))
    im = V.images(s, d).select("image_id").join(per, "image_id", "left")
    own = F.when(C("t") > 0, C("c") / C("t")).otherwise(1.0)
    return im.agg(N().alias("images"), F.round(F.sum("c") / F.sum("t"), 9).alias("micro_recall"), F.round(F.avg(own), 9).alias("macro_recall"))


@query("ag13_scorecard_by_class", _CELLS + """ SELECT class_id, round(sum(covered_area) / sum(truth_area), 9) AS micro_recall, round(1 - sum(covered_area) / sum(truth_area), 9) AS leakage,
  round(avg(CASE WHEN truth_area > 0 THEN covered_area / truth_area ELSE 1 END), 9) AS macro_recall FROM cov GROUP BY 1""")
def ag13(s: SparkSession, d: str) -> DataFrame:
    r = F.sum("covered_area") / F.sum("truth_area")
    per = F.when(C("truth_area") > 0, C("covered_area") / C("truth_area")).otherwise(1.0)
    return covered(s, d).groupBy("class_id").agg(F.round(r, 9).alias("micro_recall"), F.round(1 - r, 9).alias("leakage"), F.round(F.avg(per), 9).alias("macro_recall"))


@query("ag13_negative_rate", f"""WITH {V.EVIDENCE_SQL}, p AS (SELECT DISTINCT image_id FROM instances WHERE class_id = 3), e AS (SELECT DISTINCT image_id FROM evidence WHERE class_id = 4 AND confidence >= 0.5)
SELECT count(*) AS negatives, round(avg((e.image_id IS NOT NULL)::INT), 9) AS false_positive_rate FROM images i LEFT JOIN e USING (image_id) WHERE i.image_id NOT IN (SELECT image_id FROM p)""")
def ag13b(s: SparkSession, d: str) -> DataFrame:
    pos = truths(s, d).filter("class_id = 3").select("image_id").distinct()
    e = detections(s, d).filter("class_id = 4 and score >= 0.5").select("image_id", F.lit(1).alias("hit")).distinct()
    neg = V.images(s, d).select("image_id").join(pos, "image_id", "left_anti").join(e, "image_id", "left")
    return neg.agg(N().alias("negatives"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("false_positive_rate"))


@query("ag19_mask_coverage", _CELLS + """, p AS (SELECT covered_area / truth_area AS r, extra_area FROM cov WHERE truth_area > 0)
SELECT count(*) AS n, round_even(avg((r >= 0.8)::INT), 4) AS well_covered, round_even(median(r), 4) AS median_cover, round_even(median(r) FILTER (r > 0), 4) AS median_when_touched FROM p""")
def ag19(s: SparkSession, d: str) -> DataFrame:
    p = covered(s, d).filter("truth_area > 0").select((C("covered_area") / C("truth_area")).alias("r"))
    return p.agg(N().alias("n"), F.bround(F.avg((C("r") >= 0.8).cast("int")), 4).alias("well_covered"), F.bround(F.median("r"), 4).alias("median_cover"), F.bround(F.median(F.when(C("r") > 0, C("r"))), 4).alias("median_when_touched"))


@query("ag19_erasure", _CELLS + """, im AS (SELECT i.image_id, (i.width * i.height)::DOUBLE AS size, coalesce(sum(truth_area), 0) AS t, coalesce(sum(covered_area + extra_area), 0) AS e FROM images i LEFT JOIN cov USING (image_id) GROUP BY ALL)
SELECT round_even(avg(e / size) FILTER (t > 0), 4) AS mean_erased, count(*) FILTER (t = 0) AS clean_images, round_even(avg((e > 0)::INT) FILTER (t = 0), 4) AS false_alarm_rate,
  round_even(avg(e / size) FILTER (t = 0), 4) AS mean_erased_clean, coalesce(round_even(median(e / size) FILTER (t = 0 AND e > 0), 4), 0) AS median_when_touched FROM im""")
def ag19b(s: SparkSession, d: str) -> DataFrame:
    """How much is erased: on average where there is something to cover, and on clean images how often and how much."""
    per = covered(s, d).groupBy("image_id").agg(F.sum("truth_area").alias("t"), F.sum(C("covered_area") + C("extra_area")).alias("e"))
    im = V.images(s, d).select("image_id", (C("width") * C("height")).alias("size")).join(per, "image_id", "left").na.fill(0.0, ["t", "e"])
    share, clean = C("e") / C("size"), C("t") == 0
    return im.agg(
        F.bround(F.avg(F.when(~clean, share)), 4).alias("mean_erased"), F.count_if(clean).alias("clean_images"), F.bround(F.avg(F.when(clean, (C("e") > 0).cast("int"))), 4).alias("false_alarm_rate"),
        F.bround(F.avg(F.when(clean, share)), 4).alias("mean_erased_clean"), F.coalesce(F.bround(F.median(F.when(clean & (C("e") > 0), share)), 4), F.lit(0.0)).alias("median_when_touched"))


def fused(s: SparkSession, d: str) -> DataFrame:
    kept = P.filtered(s, d).filter("reason is null").select("image_id", C("evidence_id").alias("id"), "provider", "class_name", "confidence", "x0", "y0", "w", "h")
    return M.touching_components(kept, ["image_id"]).join(kept.select("id", "provider", "class_name", "confidence"), "id")


_FUSED = P._LOOK.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k AS (SELECT * FROM look WHERE {P._REASON} IS NULL),
e AS (SELECT a.evidence_id AS u, b.evidence_id AS v FROM k a JOIN k b ON a.image_id = b.image_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h),
r(id, v) AS (SELECT u, v FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.v), comp AS (SELECT id, min(v) AS component FROM r GROUP BY 1)"""


@query("st7_touching_components", P._LOOK + f""", k AS (SELECT * FROM look WHERE {P._REASON} IS NULL),
e AS (SELECT a.evidence_id AS u, b.evidence_id AS v FROM k a JOIN k b ON a.image_id = b.image_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h)
SELECT id, min(v) AS component FROM (WITH RECURSIVE r(id, v) AS (SELECT u, v FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.v) SELECT * FROM r) GROUP BY 1""")
def st7(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d).select("id", "component")


@query("ag17_fusion_provenance", _FUSED + """ SELECT image_id, component, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers,
  string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS classes, max(confidence) AS confidence FROM comp JOIN k ON evidence_id = id GROUP BY 1, 2""")
def ag17(s: SparkSession, d: str) -> DataFrame:
    j = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return fused(s, d).groupBy("image_id", "component").agg(j("id").alias("ids"), j("provider").alias("providers"), j("class_name").alias("classes"), F.max("confidence").alias("confidence"))


@query("wn8_median_exemplar", f"""WITH {V.INSTANCES_SQL}, m AS (SELECT class_id, split, median(w * h) AS m FROM instances GROUP BY 1, 2),
r AS (SELECT i.class_id, i.split, image_id, instance_id, row_number() OVER (PARTITION BY i.class_id, i.split ORDER BY abs(w * h - m), w * h DESC, image_id, instance_id) AS k FROM instances i JOIN m USING (class_id, split))
SELECT class_id, split, image_id, instance_id FROM r WHERE k = 1""")
def wn8(s: SparkSession, d: str) -> DataFrame:
    i = V.instances(s, d).select("class_id", "split", "image_id", "instance_id", (C("w") * C("h")).alias("area"))
    m = i.groupBy("class_id", "split").agg(F.median("area").alias("m"))
    order = F.struct(F.abs(C("area") - C("m")), -C("area"), "image_id", "instance_id")
    best = i.join(F.broadcast(m), ["class_id", "split"]).groupBy("class_id", "split").agg(F.min_by(F.struct("image_id", "instance_id"), order).alias("b"))
    return best.select("class_id", "split", "b.*")


def quota_pick(candidates: list, quota: int, quota_until: int, most: int) -> list:
    """In order, at most ``quota`` of a class while fewer than ``quota_until`` are chosen, ``most`` in all; no image twice."""
    out, per, used = [], {}, set()
    for r in candidates:
        if len(out) >= most:
            break
        if r["image_id"] in used or (len(out) < quota_until and per.get(r["class_id"], 0) >= quota):
            continue
        out.append(r)
        used.add(r["image_id"])
        per[r["class_id"]] = per.get(r["class_id"], 0) + 1
    return out


@query("wn9_review_list", f"""WITH RECURSIVE {V.EVIDENCE_SQL}, low AS (SELECT * FROM (SELECT image_id, class_id, evidence_id, confidence, row_number() OVER (PARTITION BY class_id ORDER BY confidence, evidence_id) AS j FROM evidence) WHERE j <= 108),
c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY confidence, evidence_id) AS k FROM low),
r AS (SELECT 0::BIGINT AS k, []::STRUCT(i BIGINT, c INT, e VARCHAR)[] AS s
  UNION ALL SELECT c.k, CASE WHEN len(s) < 12 AND len(list_filter(s, lambda x: x.i = c.image_id)) = 0 AND (len(s) >= 10 OR len(list_filter(s, lambda x: x.c = c.class_id)) < 3) THEN list_append(s, {{'i': c.image_id, 'c': c.class_id, 'e': c.evidence_id}}) ELSE s END FROM r JOIN c ON c.k = r.k + 1),
f AS (SELECT s FROM r ORDER BY k DESC LIMIT 1), u AS (SELECT unnest(s) AS x, generate_subscripts(s, 1) AS place FROM f)
SELECT place::INT AS place, x.i AS image_id, x.c AS class_id, x.e AS evidence_id FROM u""")
def wn9(s: SparkSession, d: str) -> DataFrame:
    # A class can give at most 12 of the 12 rows and one image at most 9 of them, so 9 x 12 candidates a class decide the list.
    low = M.top_per_group(V.evidence(s, d).select("image_id", "class_id", "evidence_id", "confidence"), ["class_id"], [C("confidence"), C("evidence_id")], 108)
    rows = quota_pick(low.orderBy("confidence", "evidence_id").collect(), 3, 10, 12)
    return s.createDataFrame([(k + 1, r["image_id"], r["class_id"], r["evidence_id"]) for k, r in enumerate(rows)], "place int, image_id long, class_id int, evidence_id string")


@query("wn10_middle_records", f"""WITH RECURSIVE {V.INSTANCES_SQL}, per AS (SELECT split, class_id, image_id, count(*) AS k FROM instances GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY split, class_id ORDER BY k, image_id) AS r, count(*) OVER (PARTITION BY split, class_id) AS n FROM per),
c AS MATERIALIZED (SELECT split, class_id, image_id, row_number() OVER (ORDER BY split, class_id, r) AS j FROM o WHERE r > n // 2 AND r <= n // 2 + 6),
s AS (SELECT 0::BIGINT AS j, []::STRUCT(s VARCHAR, c INT, i BIGINT)[] AS s
  UNION ALL SELECT c.j, CASE WHEN len(list_filter(s.s, lambda x: x.s = c.split)) < 5 AND len(list_filter(s.s, lambda x: x.s = c.split AND (x.c = c.class_id OR x.i = c.image_id))) = 0 THEN list_append(s.s, {{'s': c.split, 'c': c.class_id, 'i': c.image_id}}) ELSE s.s END FROM s JOIN c ON c.j = s.j + 1),
f AS (SELECT s FROM s ORDER BY j DESC LIMIT 1) SELECT x.s AS split, x.c AS class_id, x.i AS image_id FROM (SELECT unnest(s) AS x FROM f)""")
def wn10(s: SparkSession, d: str) -> DataFrame:
    """For each class the middle image of a split by (instances, id), an image not used twice, up to five a split."""
    per = V.instances(s, d).groupBy("split", "class_id", "image_id").agg(N().alias("k"))
    w = W.partitionBy("split", "class_id").orderBy("k", "image_id")
    # the middle and, as at most five images of a split are taken, the five after it
    mid = per.withColumn("r", F.row_number().over(w)).withColumn("n", N().over(W.partitionBy("split", "class_id"))).filter((C("r") > F.floor(C("n") / 2)) & (C("r") <= F.floor(C("n") / 2) + 6))
    out, used = [], {}
    for r in mid.orderBy("split", "class_id", "r").collect():
        seen = used.setdefault(r["split"], {})
        if len(seen) < 5 and r["class_id"] not in seen.values() and r["image_id"] not in seen:
            seen[r["image_id"]] = r["class_id"]
            out.append((r["split"], r["class_id"], r["image_id"]))
    return s.createDataFrame(out, "split string, class_id int, image_id long")
