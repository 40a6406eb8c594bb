"""Queries of aggregates and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.ordering import global_rank, ranged
from ..session import cut, table
from . import records as P
from . import views as V
from .registry import query

C, N = F.col, P.N
_INST = f"WITH {V.INSTANCES_SQL}"


@query("ag1_manifest_summary", f"WITH {V.IMAGES_SQL} SELECT split, count(*) AS images, count(image_path) AS available FROM images GROUP BY GROUPING SETS ((split), ())")
def ag1(s: SparkSession, d: str) -> DataFrame:
    return V.images(s, d).rollup("split").agg(N().alias("images"), F.count("image_path").alias("available"))


@query("ag2_status_counts", P._ROUTED + f""", cl AS (SELECT DISTINCT l_orderkey AS image_id, 1 + l_partkey % 9 AS class_id FROM lineitem)
SELECT 'all' AS level, '' AS key, status, count(*) AS n FROM routed GROUP BY status UNION ALL SELECT 'split', split, status, count(*) FROM routed GROUP BY split, status
UNION ALL SELECT 'class', class_id::VARCHAR, status, count(*) FROM routed JOIN cl USING (image_id) GROUP BY class_id, status""")
def ag2(s: SparkSession, d: str) -> DataFrame:
    r = P.routed(s, d).select("image_id", "split", "status")
    by = lambda df, level, key: df.groupBy(F.lit(level).alias("level"), key.alias("key"), "status").agg(N().alias("n"))
    classes = V.instances(s, d).select("image_id", "class_id").distinct()
    return by(r, "all", F.lit("")).unionByName(by(r, "split", C("split"))).unionByName(by(r.join(classes, "image_id"), "class", C("class_id").cast("string")))


@query("ag3_training_profile", _INST + """, per AS (SELECT i.image_id, i.split, count(n.image_id) AS k FROM images i LEFT JOIN instances n ON n.image_id = i.image_id GROUP BY 1, 2),
cls AS (SELECT split, class_id, count(*) AS n FROM instances GROUP BY 1, 2), sz AS (SELECT split, count(*) FILTER (w * h < 1024) AS small, count(*) FILTER (w * h >= 1024 AND w * h < 9216) AS medium, count(*) FILTER (w * h >= 9216) AS large FROM instances GROUP BY 1),
a AS (SELECT split, count(*) AS images, count(*) FILTER (k = 0) AS negatives, sum(k)::BIGINT AS instances, round(avg(k), 9) AS mean_instances, max(k) AS most, min(image_id) FILTER (k = m) AS most_image FROM (SELECT *, max(k) OVER (PARTITION BY split) AS m FROM per) GROUP BY 1),
b AS (SELECT split, arg_min(class_id, n * 100 + class_id) AS least_class, arg_max(class_id, n * 100 - class_id) AS most_class, round(max(n) / min(n), 9) AS ratio FROM cls GROUP BY 1)
SELECT * FROM a JOIN b USING (split) JOIN sz USING (split)""")
def ag3(s: SparkSession, d: str) -> DataFrame:
    inst = V.instances(s, d).select("image_id", "split", "class_id", (C("w") * C("h")).alias("area"))
    per = V.images(s, d).select("image_id", "split").join(inst.groupBy("image_id").agg(N().alias("k")), "image_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    a = per.groupBy("split").agg(
        N().alias("images"), F.count_if(C("k") == 0).alias("negatives"), F.sum("k").alias("instances"), F.round(F.avg("k"), 9).alias("mean_instances"),
        F.max("k").alias("most"), F.max_by("image_id", F.struct("k", -C("image_id"))).alias("most_image"))
    c = inst.groupBy("split", "class_id").agg(N().alias("n")).groupBy("split").agg(
        F.min_by("class_id", F.struct("n", "class_id")).alias("least_class"), F.max_by("class_id", F.struct(C("n"), -C("class_id"))).alias("most_class"), F.round(F.max("n") / F.min("n"), 9).alias("ratio"))
    b = G.size_bucket(C("area"))
    z = inst.groupBy("split").agg(*(F.count_if(b == n).alias(n) for n in ("small", "medium", "large")))
    return a.join(c, "split").join(z, "split")


_SUPPORT = _INST + f""", names(class_id, class_name) AS (VALUES {P._NAMES_SQL}), sp AS (SELECT split, count(*) AS total FROM images GROUP BY 1),
c AS (SELECT split, class_id, count(*) AS instances, count(DISTINCT image_id) AS images FROM instances GROUP BY 1, 2),
support AS (SELECT sp.split, n.class_id, n.class_name, coalesce(c.images, 0) AS images, coalesce(c.instances, 0) AS instances, round(coalesce(c.images, 0) / total, 9) AS prevalence
  FROM sp CROSS JOIN names n LEFT JOIN c ON c.split = sp.split AND c.class_id = n.class_id)"""


def class_support(s: SparkSession, d: str) -> DataFrame:
    """Images and instances of each class and split, zero where there are none. Partial counts per image first, so no count distinct shuffle."""
    per = V.instances(s, d).groupBy("split", "class_id", "image_id").agg(N().alias("k")).groupBy("split", "class_id").agg(N().alias("images"), F.sum("k").alias("instances"))
    totals = V.images(s, d).groupBy("split").agg(N().alias("total"))
    names = F.array(*(F.struct(F.lit(k).alias("class_id"), F.lit(v).alias("class_name")) for k, v in V.CLASSES.items()))
    grid = totals.select("split", "total", F.explode(names).alias("c")).select("split", "total", "c.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = grid.join(per, ["split", "class_id"], "left").select("split", "class_id", "class_name", zero("images"), zero("instances"), "total")
    return out.withColumn("prevalence", F.round(C("images") / C("total"), 9)).drop("total")


@query("ag4_class_support", _SUPPORT + " SELECT * FROM support")
def ag4(s: SparkSession, d: str) -> DataFrame:
    return class_support(s, d)


@query("ag5_size_crosstab", _INST + """, c AS (SELECT class_id, count(*) FILTER (w * h < 1024) AS a, count(*) FILTER (w * h >= 1024 AND w * h < 9216) AS b, count(*) FILTER (w * h >= 9216) AS c, count(*) AS n FROM instances GROUP BY 1)
SELECT class_id, round(100 * a / n, 6) AS small, round(100 * b / n, 6) AS medium, round(100 * c / n, 6) AS large FROM c""")
def ag5(s: SparkSession, d: str) -> DataFrame:
    df = V.instances(s, d).withColumn("bucket", G.size_bucket(C("w") * C("h"))).groupBy("class_id").pivot("bucket", ["small", "medium", "large"]).count().na.fill(0)
    total = C("small") + C("medium") + C("large")
    return df.select("class_id", *(F.round(100 * C(c) / total, 6).alias(c) for c in ("small", "medium", "large")))


@query("ag6_cooccurrence", _INST + """, c AS (SELECT DISTINCT image_id, class_id FROM instances)
SELECT a.class_id AS left_class, b.class_id AS right_class, count(*) AS images FROM c a JOIN c b USING (image_id) GROUP BY 1, 2""")
def ag6(s: SparkSession, d: str) -> DataFrame:
    # the pairs come from each image's set of classes, so no self-join and no shuffle beyond the grouping by image
    sets = V.instances(s, d).groupBy("image_id").agg(F.collect_set("class_id").alias("cs"))
    return sets.select("cs", F.explode("cs").alias("left_class")).select("left_class", F.explode("cs").alias("right_class")).groupBy("left_class", "right_class").agg(N().alias("images"))


_WEIGHTS = _INST + """, cc AS (SELECT class_id, count(*) AS n FROM instances WHERE split = 'train2017' GROUP BY 1),
rw AS (SELECT i.image_id, max(pow(cc.n, -0.5)) AS w FROM images i LEFT JOIN (SELECT DISTINCT image_id, class_id FROM instances) x ON x.image_id = i.image_id LEFT JOIN cc USING (class_id) WHERE i.split = 'train2017' GROUP BY 1),
pos AS (SELECT w, row_number() OVER (ORDER BY w) AS k, count(*) OVER () AS n FROM rw WHERE w IS NOT NULL), med AS (SELECT w AS m FROM pos WHERE k = n // 2 + 1),
cw AS (SELECT image_id, least(coalesce(w, m * 0.5), m * 5.0) AS w FROM rw, med), sw AS (SELECT image_id, w / avg(w) OVER () AS weight FROM cw)"""


def upper_median(values: DataFrame, c: str) -> float | None:
    """The element at place n // 2 (from 0) of the sorted values, from counts of distinct values; null if there are none.

    The counts are cumulated over ranges of values, so no task sorts all rows.
    """
    v = values.filter(C(c).isNotNull()).groupBy(c).agg(N().alias("n"))
    total = v.agg(F.sum("n")).first()[0]
    if not total:
        return None
    ordered = ranged(v, C(c))
    sums = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    seen, want = 0, total // 2
    for p in sorted(sums):
        if seen + sums[p] > want:
            run = F.sum("n").over(W.partitionBy("_part").orderBy(c))
            row = ordered.filter(C("_part") == p).withColumn("run", run + seen).filter(C("run") > want).orderBy(c).first()
            return row[c]
        seen += sums[p]
    return None


def sampler_weights(s: SparkSession, d: str) -> DataFrame:
    """(image_id, weight) of the train images: the rarest class's count ^ -0.5, negatives half the median, capped at five medians, mean 1."""
    inst = V.instances(s, d).filter("split = 'train2017'").select("image_id", "class_id")
    counts = inst.groupBy("class_id").agg(F.pow(N(), F.lit(-0.5)).alias("w"))
    per = inst.distinct().join(F.broadcast(counts), "class_id").groupBy("image_id").agg(F.max("w").alias("w"))
    raw = V.images(s, d).filter("split = 'train2017'").select("image_id").join(per, "image_id", "left")
    m = upper_median(raw, "w") or 1.0
    capped = raw.select("image_id", F.least(F.coalesce("w", F.lit(m * 0.5)), F.lit(m * 5.0)).alias("w"))
    mean = capped.agg(F.avg("w")).first()[0]
    return capped.select("image_id", (C("w") / F.lit(mean)).alias("weight"))


@query("sm1_balanced_weights", _WEIGHTS + " SELECT image_id, round(weight, 9) AS weight FROM sw")
def sm1(s: SparkSession, d: str) -> DataFrame:
    return sampler_weights(s, d).select("image_id", F.round("weight", 9).alias("weight"))


@query("sm1_weighted_draw", _WEIGHTS + """, c AS (SELECT image_id, sum(weight) OVER (ORDER BY image_id) AS hi, weight FROM sw),
u AS (SELECT j AS draw, ('0x' || substr(md5('11:' || j), 1, 12))::BIGINT / 281474976710656::DOUBLE * (SELECT max(hi) FROM c) AS u FROM range((SELECT count(*) FROM sw)) t(j))
SELECT draw, image_id FROM u ASOF JOIN c ON u.u < c.hi""")
def sm1b(s: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import weighted_draw

    w = cut(sampler_weights(s, d))
    return weighted_draw(w, "image_id", "weight", w.count(), 11)


@query("ag7_sampler_profile", _WEIGHTS + """, p AS (SELECT weight / sum(weight) OVER () AS p, count(*) OVER () AS n FROM sw)
SELECT count(*) AS images, round(sum(1 - pow(1 - p, n)), 6) AS expected_unique, round(max(p) / min(p), 6) AS max_to_min FROM p""")
def ag7(s: SparkSession, d: str) -> DataFrame:
    w = sampler_weights(s, d)
    total, n = w.agg(F.sum("weight"), N()).first()
    p = C("weight") / F.lit(total)
    return w.agg(N().alias("images"), F.round(F.sum(1 - F.pow(1 - p, F.lit(n))), 6).alias("expected_unique"), F.round(F.max("weight") / F.min("weight"), 6).alias("max_to_min"))


@query("ag8_split_shift", f"""WITH {V.IMAGES_SQL}, m AS (SELECT split, round(width * height / 1e6::DOUBLE, 6) AS v FROM images WHERE split <> 'test2017'),
st AS (SELECT avg(v) FILTER (split = 'train2017') AS a, avg(v) FILTER (split = 'val2017') AS b, var_samp(v) FILTER (split = 'train2017') AS va, var_samp(v) FILTER (split = 'val2017') AS vb FROM m),
ec AS (SELECT v, sum((split = 'train2017')::INT) OVER (ORDER BY v)::DOUBLE / sum((split = 'train2017')::INT) OVER () - sum((split = 'val2017')::INT) OVER (ORDER BY v)::DOUBLE / sum((split = 'val2017')::INT) OVER () AS d FROM m)
SELECT 'megapixels' AS metric, round(a, 6) AS train_mean, round(b, 6) AS val_mean, round((b - a) / sqrt((va + vb) / 2), 6) AS standardized, round((SELECT max(abs(d)) FROM ec), 6) AS ks FROM st""")
def ag8(s: SparkSession, d: str) -> DataFrame:
    m = V.images(s, d).filter("split <> 'test2017'").select("split", F.round(C("width") * C("height") / 1e6, 6).alias("v"))
    one = lambda f, sp: f(F.when(C("split") == sp, C("v")))
    st = m.agg(one(F.avg, "train2017").alias("a"), one(F.avg, "val2017").alias("b"), one(F.var_samp, "train2017").alias("va"), one(F.var_samp, "val2017").alias("vb"),
               F.count_if(C("split") == "train2017").alias("na"), F.count_if(C("split") == "val2017").alias("nb"))
    return st.withColumn("ks", F.lit(ks_statistic(m))).select(
        F.lit("megapixels").alias("metric"), F.round("a", 6).alias("train_mean"), F.round("b", 6).alias("val_mean"),
        F.round((C("b") - C("a")) / F.sqrt((C("va") + C("vb")) / 2), 6).alias("standardized"), F.round("ks", 6).alias("ks"))


def ks_statistic(m: DataFrame) -> float | None:
    """Largest distance of the two distribution functions of v in train2017 and val2017, by running counts within value ranges."""
    counts = m.groupBy("v").agg(F.count_if(C("split") == "train2017").alias("a"), F.count_if(C("split") == "val2017").alias("b"))
    ordered = ranged(counts, C("v"))
    parts = sorted(ordered.groupBy("_part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect())  # one row a partition
    na, nb = sum(p["a"] for p in parts), sum(p["b"] for p in parts)
    if not na or not nb:
        return None
    base, before = [], [0, 0]
    for p in parts:
        base.append((p["_part"], *before))
        before = [before[0] + p["a"], before[1] + p["b"]]
    at = ordered.sparkSession.createDataFrame(base, "_part int, ba long, bb long")
    w = W.partitionBy("_part").orderBy("v")
    run = ordered.join(F.broadcast(at), "_part").select(((F.sum("a").over(w) + C("ba")) / na - (F.sum("b").over(w) + C("bb")) / nb).alias("d"))
    return run.agg(F.max(F.abs("d"))).first()[0]


@query("ag8_class_distance", _INST + """, c AS (SELECT class_id, count(*) FILTER (split = 'train2017') AS a, count(*) FILTER (split = 'val2017') AS b FROM instances GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END)), 9) AS jensen_shannon FROM p""")
def ag8b(s: SparkSession, d: str) -> DataFrame:
    c = V.instances(s, d).groupBy("class_id").agg(F.count_if(C("split") == "train2017").alias("a"), F.count_if(C("split") == "val2017").alias("b"))
    t = c.agg(F.sum("a"), F.sum("b")).first()
    p, q = C("a") / F.lit(t[0]), C("b") / F.lit(t[1])
    part = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / 2)) / 2).otherwise(0.0)
    return c.agg(F.round(F.sqrt(F.sum(part(p) + part(q))), 9).alias("jensen_shannon"))


@query("ag18_bootstrap_interval", """WITH v AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, p_retailprice AS x, count(*) OVER () AS n FROM part),
dr AS (SELECT b, j FROM range(1000) t(b), range((SELECT any_value(n) FROM v)) u(j)),
ix AS (SELECT b, ('0x' || substr(md5('1337:' || b || ':' || j), 1, 12))::BIGINT % (SELECT any_value(n) FROM v) AS k FROM dr),
m AS (SELECT b, avg(x) AS m FROM ix JOIN v USING (k) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS lower_95, round(quantile_cont(m, 0.975), 6) AS upper_95 FROM m""")
def ag18(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "part").select("p_partkey", C("p_retailprice").alias("x"))
    return bootstrap_interval(v, "p_partkey", "x", draws=1000, seed=1337)


def bootstrap_interval(values: DataFrame, key: str, x: str, draws: int, seed: int) -> DataFrame:
    """95 % interval of the mean from ``draws`` resamples with replacement; which rows are drawn follows from a digest of seed, draw and place."""
    ranked = global_rank(values, [C(key)], "k").withColumn("k", C("k") - 1)
    n = ranked.count()
    spark = values.sparkSession
    # One range over all draws and places, so that the planner knows its size: exploded draws were taken for n rows and broadcast.
    ix = spark.range(n * draws).select((C("id") % F.lit(max(n, 1))).alias("j"), F.expr(f"id div {max(n, 1)}").cast("int").alias("b"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), C("b").cast("string"), C("j").cast("string"))), 1, 12), 16, 10).cast("bigint")
    means = ix.select("b", (digest % F.lit(max(n, 1))).alias("k")).join(ranked.select("k", x), "k").groupBy("b").agg(F.avg(x).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lower_95"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("upper_95"))


@query("ag20_overlapping_groups", f"""WITH {V.IMAGES_SQL}, f AS (SELECT *, least(width, height) >= 600 AS scene, greatest(width, height) < 900 AS crop, image_path IS NULL AS err FROM images),
g AS (SELECT 'all' AS grp, * FROM f UNION ALL SELECT 'split:' || split, * FROM f UNION ALL SELECT 'scene_like', * FROM f WHERE scene UNION ALL SELECT 'crop_like', * FROM f WHERE crop UNION ALL SELECT 'scene_like_and_crop_like', * FROM f WHERE scene AND crop)
SELECT grp, count(*) AS images, count(*) FILTER (NOT err) AS valid_images, round(avg(width) FILTER (NOT err), 6) AS mean_width, round(median(width) FILTER (NOT err), 6) AS median_width FROM g GROUP BY 1""")
def ag20(s: SparkSession, d: str) -> DataFrame:
    scene, crop = F.least("width", "height") >= 600, F.greatest("width", "height") < 900
    groups = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("split:"), C("split")), F.when(scene, "scene_like"), F.when(crop, "crop_like"), F.when(scene & crop, "scene_like_and_crop_like")))
    df = V.images(s, d).select(F.explode(groups).alias("grp"), F.when(C("image_path").isNotNull(), C("width")).alias("w"))
    return df.groupBy("grp").agg(N().alias("images"), F.count("w").alias("valid_images"), F.round(F.avg("w"), 6).alias("mean_width"), F.round(F.median("w"), 6).alias("median_width"))


@query("ag21_grouping_sets", _INST + """ SELECT CASE WHEN w * h < 1024 THEN 'small' WHEN w * h < 9216 THEN 'medium' ELSE 'large' END AS bucket, class_id, count(*) AS n, round(avg(w / h::DOUBLE), 6) AS aspect
FROM instances GROUP BY GROUPING SETS ((1), (class_id), ())""")
def ag21(s: SparkSession, d: str) -> DataFrame:
    df = V.instances(s, d).select(G.size_bucket(C("w") * C("h")).alias("bucket"), "class_id", (C("w") / C("h")).alias("r"))
    return df.groupingSets([[C("bucket")], [C("class_id")], []], "bucket", "class_id").agg(N().alias("n"), F.round(F.avg("r"), 6).alias("aspect"))


@query("ag22_parquet_audit", """WITH m AS (SELECT r FROM (SELECT l_extendedprice / l_quantity AS r, row_number() OVER (ORDER BY l_extendedprice / l_quantity) AS k, count(*) OVER () AS n FROM lineitem) WHERE k = n // 2 + 1)
SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_discount > 0.09 OR l_tax > 0.07) AS out_of_bounds, (SELECT round(r, 6) FROM m) AS upper_median_ratio FROM lineitem""")
def ag22(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_tax", (C("l_extendedprice") / C("l_quantity")).alias("r"))
    m = upper_median(li, "r")
    return li.agg(N().alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"),
                  F.count_if((C("l_discount") > 0.09) | (C("l_tax") > 0.07)).alias("out_of_bounds")).withColumn("upper_median_ratio", F.round(F.lit(m), 6))


@query("ag22_top_values", "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def ag22b(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(C("l_suppkey").alias("value")).agg(N().alias("n")).orderBy(F.desc("n"), "value").limit(20)


_AUDIT = """WITH a AS (SELECT DISTINCT record_id, dataset_id, group_id, source_split, width, boxes, errors, annotation_qa, image_sha256 FROM audit_yolo_detection_dataset),
b AS (SELECT unnest(boxes).class_id AS class_id, unnest(boxes).width * width AS pixels FROM a)"""


@query("ag23_label_detail", _AUDIT + """ SELECT 'class' AS kind, class_id::VARCHAR AS key, count(*) AS n FROM b GROUP BY 2
UNION ALL SELECT 'width', CASE WHEN pixels < 32 THEN 'tiny' WHEN pixels < 64 THEN 'small' WHEN pixels < 128 THEN 'medium' ELSE 'large' END, count(*) FROM b WHERE pixels IS NOT NULL GROUP BY 2
UNION ALL SELECT 'blocking', 'decode', count(*) FROM a WHERE width IS NULL UNION ALL SELECT 'blocking', 'labels', coalesce(sum(len(errors)), 0)::BIGINT FROM a
UNION ALL SELECT 'blocking', 'groups', count(*) FROM (SELECT 1 FROM a WHERE group_id IS NOT NULL GROUP BY dataset_id, group_id HAVING count(DISTINCT source_split) > 1)""")
def ag23b(s: SparkSession, d: str) -> DataFrame:
    """Boxes by class and by width in pixels, and what blocks a release: undecodable images, label errors, groups across splits."""
    a = cut(audit_records(s, d))
    boxes = a.select(F.explode("boxes").alias("b"), "width").select("b.class_id", (C("b.width") * C("width")).alias("pixels"))
    width = F.when(C("pixels") < 32, "tiny").when(C("pixels") < 64, "small").when(C("pixels") < 128, "medium").otherwise("large")
    crossing = a.filter("group_id is not null").groupBy("dataset_id", "group_id").agg(F.count_distinct("source_split").alias("k")).filter("k > 1")
    one = lambda df, kind, key, n: df.select(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))
    parts = [
        one(boxes.groupBy("class_id").agg(N().alias("n")), "class", C("class_id").cast("string"), C("n")),
        one(boxes.filter("pixels is not null").groupBy(width.alias("w")).agg(N().alias("n")), "width", C("w"), C("n")),
        one(a.agg(F.count_if(C("width").isNull()).alias("n")), "blocking", F.lit("decode"), C("n")),
        one(a.agg(F.coalesce(F.sum(F.when(C("errors").isNotNull(), F.size("errors"))), F.lit(0)).alias("n")), "blocking", F.lit("labels"), C("n")),
        one(crossing.agg(N().alias("n")), "blocking", F.lit("groups"), C("n")),
    ]
    return union_all(parts)


def audit_records(s: SparkSession, d: str) -> DataFrame:
    """One row a record of the audit table; re-delivered rows have the same content."""
    cols = ["record_id", "dataset_id", "group_id", "source_split", "width", "boxes", "errors", "annotation_qa", "image_sha256"]
    return table(s, d, "audit_yolo_detection_dataset").select(*cols).dropDuplicates(["record_id"])


@query("ag23_label_audit", """WITH a AS (SELECT DISTINCT record_id, source_split, width, boxes, errors FROM audit_yolo_detection_dataset)
SELECT source_split, count(*) AS records, count(*) FILTER (len(boxes) > 0) AS positive, sum(len(boxes))::BIGINT AS boxes, sum(len(errors))::BIGINT AS errors, min(width) AS min_width, median(width) AS median_width FROM a GROUP BY 1""")
def ag23(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").select("record_id", "source_split", "width", F.size("boxes").alias("nb"), F.size("errors").alias("ne")).dropDuplicates(["record_id"])
    some = lambda c: F.when(C(c) >= 0, C(c))
    return a.groupBy("source_split").agg(N().alias("records"), F.count_if(C("nb") > 0).alias("positive"), F.sum(some("nb")).alias("boxes"), F.sum(some("ne")).alias("errors"), F.min("width").alias("min_width"), F.median("width").alias("median_width"))


@query("ag24_duplicate_ids_paths", """SELECT 'image_id' AS kind, image_id AS value, count(*) AS n FROM processed_records WHERE image_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'image_path', lower(image_path), count(DISTINCT image_id) FROM processed_records WHERE image_path IS NOT NULL GROUP BY 2 HAVING count(DISTINCT image_id) > 1""")
def ag24(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "processed_records")
    ids = p.filter("image_id is not null").groupBy(C("image_id").alias("value")).agg(N().alias("n")).filter("n > 1")
    paths = p.filter("image_path is not null").groupBy(F.lower("image_path").alias("value")).agg(F.count_distinct("image_id").alias("n")).filter("n > 1")
    return ids.select(F.lit("image_id").alias("kind"), "value", "n").unionByName(paths.select(F.lit("image_path").alias("kind"), "value", "n"))


@query("ag25_group_crossing", """SELECT dataset_id, group_id, count(DISTINCT source_split) AS splits, count(DISTINCT record_id) AS records FROM audit_yolo_detection_dataset WHERE group_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_split) > 1""")
def ag25(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").filter("group_id is not null")
    return a.groupBy("dataset_id", "group_id").agg(F.count_distinct("source_split").alias("splits"), F.count_distinct("record_id").alias("records")).filter("splits > 1")


@query("ag25_manifest_quotas", """WITH a AS (SELECT * FROM audit_yolo_detection_dataset),
q AS (SELECT count(*) AS n, count(*) FILTER (coalesce(len(boxes), 0) = 0) AS negative, count(*) FILTER (len(errors) > 0) AS difficult FROM a)
SELECT 'repeated_id' AS rule, (SELECT count(*) FROM (SELECT record_id FROM a WHERE record_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS found, (SELECT count(*) FROM (SELECT record_id FROM a WHERE record_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) = 0 AS met
UNION ALL SELECT 'repeated_hash', (SELECT count(*) FROM (SELECT 1 FROM a WHERE image_sha256 IS NOT NULL GROUP BY lower(image_sha256) HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT 1 FROM a WHERE image_sha256 IS NOT NULL GROUP BY lower(image_sha256) HAVING count(*) > 1)) = 0
UNION ALL SELECT 'size', n, n >= 2000 FROM q UNION ALL SELECT 'negative', negative, negative >= 0.25::DOUBLE * n FROM q UNION ALL SELECT 'difficult', difficult, difficult >= 0.25::DOUBLE * n FROM q""")
def ag25b(s: SparkSession, d: str) -> DataFrame:
    """Ids and digests that repeat, and whether the table has the size and the shares of negative and of difficult images asked for."""
    a = table(s, d, "audit_yolo_detection_dataset").select("record_id", F.lower("image_sha256").alias("sha"), F.size("boxes").alias("boxes"), F.size("errors").alias("errors"))
    repeats = lambda c: a.filter(C(c).isNotNull()).groupBy(c).agg(N().alias("k")).filter("k > 1").agg(N().alias("found"))
    q = a.agg(N().alias("n"), F.count_if(~(F.coalesce("boxes", F.lit(0)) > 0)).alias("negative"), F.count_if(C("errors") > 0).alias("difficult"))
    rules = [("size", C("n"), C("n") >= 2000), ("negative", C("negative"), C("negative") >= 0.25 * C("n")), ("difficult", C("difficult"), C("difficult") >= 0.25 * C("n"))]
    rows = q.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), f.alias("found"), m.alias("met")) for r, f, m in rules))))
    counts = [repeats(c).select(F.lit(r).alias("rule"), "found", (C("found") == 0).alias("met")) for c, r in (("record_id", "repeated_id"), ("sha", "repeated_hash"))]
    return union_all([rows, *counts])


@query("ag26_split_summary", _INST + """, per AS (SELECT i.image_id, i.split, count(n.image_id) AS k FROM images i LEFT JOIN instances n ON n.image_id = i.image_id GROUP BY 1, 2)
SELECT split, count(*) FILTER (k > 0) AS positive, count(*) FILTER (k = 0) AS negative, sum(k)::BIGINT AS instances FROM per GROUP BY 1""")
def ag26(s: SparkSession, d: str) -> DataFrame:
    k = V.instances(s, d).groupBy("image_id").agg(N().alias("k"))
    per = V.images(s, d).select("image_id", "split").join(k, "image_id", "left")
    return per.groupBy("split").agg(F.count("k").alias("positive"), F.count_if(C("k").isNull()).alias("negative"), F.sum("k").alias("instances"))


@query("ag30_loader_statistics", _INST + """ SELECT count(DISTINCT image_id) AS images, count(*) AS positives, count(DISTINCT width || 'x' || height) AS shapes FROM instances""")
def ag30(s: SparkSession, d: str) -> DataFrame:
    return V.instances(s, d).agg(F.count_distinct("image_id").alias("images"), N().alias("positives"), F.count_distinct("width", "height").alias("shapes"))


@query("ag31_rare_classes", _SUPPORT + """ SELECT split, class_name, images, instances, CASE WHEN images < 300 THEN 'few_images' WHEN instances < 500 THEN 'few_instances' ELSE 'supported' END AS diagnosis FROM support""")
def ag31(s: SparkSession, d: str) -> DataFrame:
    return class_support(s, d).select("split", "class_name", "images", "instances", P.R.first_true(("few_images", C("images") < 300), ("few_instances", C("instances") < 500), ("supported", F.lit(True))).alias("diagnosis"))


@query("jn18_support_side_by_side", _SUPPORT + """ SELECT a.class_id, a.instances AS train_instances, b.instances AS val_instances FROM support a JOIN support b ON a.class_id = b.class_id AND a.split = 'train2017' AND b.split = 'val2017'""")
def jn18(s: SparkSession, d: str) -> DataFrame:
    p = class_support(s, d).groupBy("class_id").pivot("split", ["train2017", "val2017"]).agg(F.first("instances"))
    return p.select("class_id", C("train2017").alias("train_instances"), C("val2017").alias("val_instances"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
