"""Queries of joins, sets, ordered analytics, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_rank
from ..operators import sampling as S
from ..operators.components import star_components
from ..operators.ordering import global_rank, hash_sample
from ..operators.records import keep_best, related_groups, upsert, verify_artifacts
from ..operators.similarity import near_hash_pairs, near_images_across_splits
from ..session import table
from . import views as V
from .records import N
from .registry import query

C = F.col


@query("jn1_manifest_files", f"""WITH {V.IMAGES_SQL}, f AS (SELECT l_orderkey AS image_id, string_agg('f' || l_linenumber, ',' ORDER BY l_linenumber) AS files FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT i.image_id, split_part(files, ',', 1) AS first_file, files FROM images i LEFT JOIN f USING (image_id)""")
def jn1(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "lineitem").groupBy(C("l_orderkey").alias("image_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda k: F.concat(F.lit("f"), k.cast("string"))), ",").alias("files"))
    return V.images(s, d).select("image_id").join(f, "image_id", "left").select("image_id", F.split_part("files", F.lit(","), F.lit(1)).alias("first_file"), "files")


@query("jn2_last_wins", """SELECT image_id, row_id, width, height FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS k FROM processed_records WHERE image_id IS NOT NULL) WHERE k = 1""")
def jn2(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "processed_records").filter("image_id is not null")
    return p.groupBy("image_id").agg(F.max_by(F.struct("row_id", "width", "height"), F.struct("updated_at", "row_id")).alias("r")).select("image_id", "r.*")


@query("jn3_quarantine", f"""WITH {V.IMAGES_SQL}, q AS (SELECT o_orderkey * 7 AS image_id FROM orders WHERE o_orderkey % 5 = 0)
SELECT 'kept' AS part, count(*) AS n FROM images WHERE image_id NOT IN (SELECT image_id FROM q) UNION ALL SELECT 'quarantined', count(*) FROM images WHERE image_id IN (SELECT image_id FROM q)
UNION ALL SELECT 'listed_but_absent', count(*) FROM q WHERE image_id NOT IN (SELECT image_id FROM images)""")
def jn3(s: SparkSession, d: str) -> DataFrame:
    i = V.images(s, d).select("image_id")
    q = table(s, d, "orders").filter("o_orderkey % 5 = 0").select((C("o_orderkey") * 7).alias("image_id"))
    parts = {"kept": i.join(q, "image_id", "left_anti"), "quarantined": i.join(q, "image_id", "left_semi"), "listed_but_absent": q.join(i, "image_id", "left_anti")}
    out = None
    for name, df in parts.items():
        one = df.agg(N().alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("jn4_exact_duplicates", "SELECT image_sha256, count(DISTINCT source_split) AS splits, count(DISTINCT record_id) AS records FROM audit_yolo_detection_dataset WHERE image_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_split) > 1")
def jn4(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").filter("image_sha256 is not null")
    return a.groupBy("image_sha256").agg(F.count_distinct("source_split").alias("splits"), F.count_distinct("record_id").alias("records")).filter("splits > 1")


_SCAN = """x AS (SELECT DISTINCT images.image_id AS image_id, phash, lower(trim(images.split)) AS split, nullif(regexp_extract(lower(trim(sha256)), '^(?:sha256:)?([0-9a-f]{64})$', 1), '') AS sha
FROM same_release_split_leakage_audit WHERE phash IS NOT NULL AND images.split IS NOT NULL)"""


@query("jn5_near_hashes", f"""WITH {_SCAN} SELECT a.image_id AS left_image_id, a.split AS left_split, b.image_id AS right_image_id, b.split AS right_split, a.phash AS g, b.phash AS h, bit_count(xor(a.phash, b.phash))::INT AS distance
FROM x a JOIN x b ON a.split < b.split AND bit_count(xor(a.phash, b.phash)) <= 5 AND NOT coalesce(a.sha = b.sha, false) GROUP BY ALL""")
def jn5(s: SparkSession, d: str) -> DataFrame:
    digits = F.regexp_extract(F.lower(F.trim("sha256")), "^(?:sha256:)?([0-9a-f]{64})$", 1)
    x = table(s, d, "same_release_split_leakage_audit").select(
        "images.image_id", F.lower(F.trim(C("images.split"))).alias("split"), F.when(digits != "", digits).alias("sha256"), C("phash").alias("h"))
    return near_images_across_splits(x, 5)


@query("jn6_ordered_near_hashes", f"WITH {V.HASHES_SQL}, u AS (SELECT DISTINCT h, split FROM hashes) SELECT DISTINCT a.h AS g, b.h, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.split <> b.split AND a.h < b.h AND bit_count(xor(a.h, b.h)) <= 5 ORDER BY 3, 1, 2")
def jn6(s: SparkSession, d: str) -> DataFrame:
    u = V.hashes(s, d)
    splits = u.select("h", "split").distinct().groupBy("h").agg(F.collect_set("split").alias("sp"))
    # pairs are made in Python, where no size is known in advance, so they are never the side to broadcast
    p = near_hash_pairs(u, u, 5).filter("g < h").hint("merge").join(splits.toDF("g", "gs"), "g").join(splits, "h")
    return p.filter((F.size(F.array_except("gs", "sp")) > 0) | (F.size(F.array_except("sp", "gs")) > 0) | (F.size("gs") > 1)).select("g", "h", "distance").orderBy("distance", "g", "h")


@query("jn7_two_bands", """WITH x AS (SELECT DISTINCT phash FROM audit_yolo_detection_dataset WHERE phash IS NOT NULL) SELECT a.phash AS g, b.phash AS h, CASE WHEN bit_count(xor(a.phash, b.phash)) <= 2 THEN 'union' ELSE 'suspicious' END AS band
FROM x a JOIN x b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6""")
def jn7(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "audit_yolo_detection_dataset").select(C("phash").alias("h"))
    return near_hash_pairs(x, x, 6).filter("g < h").select("g", "h", F.when(C("distance") <= 2, "union").otherwise("suspicious").alias("band"))


@query("jn15_lookup_sample", f"WITH {V.IMAGES_SQL}, k AS (SELECT split, image_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('3:' || image_id)) AS k FROM images) WHERE k <= 20) SELECT i.split, i.image_id, width, height FROM images i JOIN k USING (split, image_id)")
def jn15(s: SparkSession, d: str) -> DataFrame:
    i = V.images(s, d)
    k = i.select("split", "image_id").withColumn("k", F.row_number().over(W.partitionBy("split").orderBy(hash_rank(3, C("image_id").cast("string"))))).filter("k <= 20")
    return i.join(F.broadcast(k.select("split", "image_id")), ["split", "image_id"], "left_semi").select("split", "image_id", "width", "height")


@query("jn16_exactly_one", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def jn16(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "region").select(C("r_regionkey").alias("k"), "r_name")
    one = r.groupBy("k").agg(F.first("r_name").alias("r_name"), N().alias("n"))
    checked = table(s, d, "nation").select("n_name", C("n_regionkey").alias("k")).join(one, "k", "left")
    ok = F.when(C("n") == 1, C("r_name")).otherwise(F.raise_error(F.concat(F.lit("not exactly one match for "), C("k").cast("string"))))
    return checked.select("n_name", ok.cast("string").alias("r_name"))


@query("jn17_artifact_verdict", """WITH m AS (SELECT 'p' || p_partkey AS path, length(p_name) + (p_partkey % 7 = 0)::INT AS bytes, CASE WHEN p_partkey % 11 = 0 THEN sha256(p_brand) ELSE upper(sha256(p_name)) END AS sha256 FROM part),
f AS (SELECT 'p' || p_partkey AS path, p_name AS content FROM part WHERE p_partkey % 13 <> 0)
SELECT m.path, CASE WHEN content IS NULL THEN 'missing' WHEN length(content) <> bytes THEN 'size_differs' WHEN sha256(content) <> lower(m.sha256) THEN 'digest_differs' ELSE 'ok' END AS verdict FROM m LEFT JOIN f USING (path)""")
def jn17(s: SparkSession, d: str) -> DataFrame:
    """Contents of files against what a manifest says of their bytes and digests."""
    p, path = table(s, d, "part"), F.concat(F.lit("p"), C("p_partkey").cast("string")).alias("path")
    digest = F.when(C("p_partkey") % 11 == 0, F.sha2("p_brand", 256)).otherwise(F.upper(F.sha2("p_name", 256)))
    manifest = p.select(path, (F.octet_length("p_name") + (C("p_partkey") % 7 == 0).cast("int")).alias("bytes"), digest.alias("sha256"))
    files = p.filter("p_partkey % 13 <> 0").select(path, F.encode("p_name", "utf-8").alias("content"))
    return verify_artifacts(manifest, files)


@query("jn19_split_moves", "SELECT images.image_id AS image_id, count(DISTINCT lower(trim(images.split))) AS splits FROM same_release_split_leakage_audit WHERE images.split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(images.split))) > 1")
def jn19(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "same_release_split_leakage_audit").select("images.image_id", F.lower(F.trim(C("images.split"))).alias("split")).filter("split is not null")
    return x.groupBy("image_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


@query("wn1_rolling_median", """SELECT event_id, user_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS m FROM events""")
def wn1(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, 7)
    return table(s, d, "events").select("event_id", "user_id", F.round(F.percentile("value", F.lit(0.5)).over(w), 9).alias("m"))


@query("wn2_epoch_numbers", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS epoch FROM events WHERE event_type = (SELECT min(event_type) FROM events)""")
def wn2(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    return global_rank(e.filter(C("event_type") == kind).select("event_id", "ts"), [C("ts"), C("event_id")], "epoch").select("event_id", "epoch")


_KEEP = """WITH a AS (SELECT record_id, image_sha256, source_split, coalesce(len(boxes), 0) AS n FROM (SELECT DISTINCT record_id, image_sha256, source_split, boxes FROM audit_yolo_detection_dataset) WHERE image_sha256 IS NOT NULL),
t AS (SELECT DISTINCT image_sha256 FROM a WHERE source_split = 'test'), r AS (SELECT a.*, t.image_sha256 IS NOT NULL AS excl FROM a LEFT JOIN t USING (image_sha256) WHERE source_split <> 'test'),
k AS (SELECT *, row_number() OVER (PARTITION BY image_sha256, excl ORDER BY n DESC, record_id) AS k, max(n) OVER (PARTITION BY image_sha256, excl) AS m FROM r)
SELECT record_id, CASE WHEN excl THEN 'present_in_higher_priority_split' WHEN k = 1 THEN 'kept' WHEN n < m THEN 'duplicate_with_fewer_instances' ELSE 'duplicate_image' END AS verdict FROM k"""


@query("wn6_keep_best", _KEEP)
def wn6(s: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("boxes"), F.lit(0)), F.lit(0))
    a = table(s, d, "audit_yolo_detection_dataset").filter("image_sha256 is not null").select("record_id", "image_sha256", "source_split", n.alias("n")).dropDuplicates(["record_id"])
    excluded = a.filter("source_split = 'test'").select("image_sha256").distinct()
    rest = a.filter("source_split <> 'test'")
    gone = rest.join(excluded, "image_sha256", "left_semi").select("record_id", F.lit("present_in_higher_priority_split").alias("verdict"))
    kept = keep_best(rest.join(excluded, "image_sha256", "left_anti"), "image_sha256", "n", "record_id")
    return gone.unionByName(kept.select("record_id", F.when(C("kept"), "kept").when(C("n") < C("most"), "duplicate_with_fewer_instances").otherwise("duplicate_image").alias("verdict")))


@query("wn7_round_robin", f"""WITH {V.INSTANCES_SQL}, b AS (SELECT i.image_id, coalesce('classes:' || string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR), 'negative') AS bucket FROM images i LEFT JOIN instances n ON n.image_id = i.image_id GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('1337:' || image_id), image_id) AS turn FROM b) SELECT image_id, bucket, turn::INT AS turn FROM r ORDER BY turn, bucket LIMIT 300""")
def wn7(s: SparkSession, d: str) -> DataFrame:
    c = V.instances(s, d).groupBy("image_id").agg(F.concat(F.lit("classes:"), F.array_join(F.array_sort(F.collect_set(C("class_id").cast("string"))), ",")).alias("bucket"))
    b = V.images(s, d).select("image_id").join(c, "image_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("negative")))
    return S.round_robin(b, "bucket", "image_id", 300, 1337)


@query("so1_sorted_records", "SELECT image_id, row_id FROM processed_records ORDER BY image_id, row_id")
def so1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "processed_records").select("image_id", "row_id").orderBy("image_id", "row_id")


@query("so2_most_common", f"WITH {V.IMAGES_SQL} SELECT width || 'x' || height AS size, count(*) AS n FROM images GROUP BY 1 ORDER BY n DESC, size LIMIT 20")
def so2(s: SparkSession, d: str) -> DataFrame:
    size = F.concat_ws("x", "width", "height").alias("size")
    return V.images(s, d).groupBy(size).agg(N().alias("n")).orderBy(F.desc("n"), "size").limit(20)


@query("so3_seeded_subset", "SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY sha256('42:' || p_partkey), p_partkey LIMIT 100) ORDER BY 1")
def so3(s: SparkSession, d: str) -> DataFrame:
    return hash_sample(table(s, d, "part").select("p_partkey"), "p_partkey", 100, 42).orderBy("p_partkey")


@query("so4_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def so4(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("so5_sorted_distances", "SELECT match_id, phash_distance FROM phash_matches WHERE phash_distance IS NOT NULL ORDER BY phash_distance, match_id")
def so5(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "phash_matches").filter("phash_distance is not null").select("match_id", "phash_distance").orderBy("phash_distance", "match_id")


@query("st1_union_sources", "SELECT source, count(*) AS n FROM (SELECT 'processed' AS source, image_id FROM processed_records UNION ALL SELECT 'payload', image_id FROM record_payloads UNION ALL SELECT 'scan', images.image_id FROM same_release_split_leakage_audit) GROUP BY 1")
def st1(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, n: table(s, d, t).select(F.lit(n).alias("source"), C(c).alias("image_id"))
    u = one("processed_records", "image_id", "processed").unionByName(one("record_payloads", "image_id", "payload")).unionByName(one("same_release_split_leakage_audit", "images.image_id", "scan"))
    return u.groupBy("source").agg(N().alias("n"))


@query("st2_intersection", "SELECT image_sha256 FROM audit_yolo_detection_dataset WHERE source_split = 'train' INTERSECT SELECT image_sha256 FROM audit_yolo_detection_dataset WHERE source_split IN ('val', 'valid')")
def st2(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").select("image_sha256", "source_split")
    return a.filter("source_split = 'train'").select("image_sha256").intersect(a.filter("source_split in ('val', 'valid')").select("image_sha256"))


@query("st3_symmetric_difference", """SELECT 'missing' AS kind, image_id FROM (SELECT image_id FROM processed_records EXCEPT SELECT images.image_id FROM same_release_split_leakage_audit)
UNION ALL SELECT 'extra', image_id FROM (SELECT images.image_id AS image_id FROM same_release_split_leakage_audit EXCEPT SELECT image_id FROM processed_records)""")
def st3(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "processed_records").select("image_id"), table(s, d, "same_release_split_leakage_audit").select("images.image_id")
    return a.subtract(b).select(F.lit("missing").alias("kind"), "image_id").unionByName(b.subtract(a).select(F.lit("extra").alias("kind"), "image_id"))


@query("st4_missing_fields", """SELECT row_id, array_to_string(list_filter(['image_path', 'geometry_status', 'instances', 'width'], lambda f: CASE f WHEN 'image_path' THEN image_path IS NULL WHEN 'geometry_status' THEN geometry_status IS NULL WHEN 'instances' THEN instances IS NULL ELSE width IS NULL END), ',') AS missing FROM processed_records""")
def st4(s: SparkSession, d: str) -> DataFrame:
    need = ["image_path", "geometry_status", "instances", "width"]
    there = F.array_compact(F.array(*(F.when(C(c).isNotNull(), F.lit(c)) for c in need)))
    return table(s, d, "processed_records").select("row_id", F.array_join(F.array_except(F.array(*map(F.lit, need)), there), ",").alias("missing"))


@query("st5_key_sets", """SELECT plan_id, count(*) FILTER (m.attr_id IS NULL) AS unknown, 24 - count(m.attr_id) AS absent FROM sample_targets t LEFT JOIN class_map m USING (attr_id) GROUP BY 1""")
def st5(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "class_map").select("attr_id", F.lit(1).alias("k"))
    n = known.count()
    return table(s, d, "sample_targets").join(F.broadcast(known), "attr_id", "left").groupBy("plan_id").agg(F.count_if(C("k").isNull()).alias("unknown"), (F.lit(n) - F.count("k")).alias("absent"))


@query("st6_components", """WITH RECURSIVE e AS (SELECT left_record_id AS u, right_record_id AS v FROM phash_matches WHERE match_kind = 'sha256' OR phash_distance <= 2),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), r(vertex, v) AS (SELECT u, v FROM b UNION SELECT r.vertex, b.v FROM r JOIN b ON b.u = r.v)
SELECT vertex, least(vertex, min(v)) AS root FROM r GROUP BY vertex""")
def st6(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "phash_matches").filter("match_kind = 'sha256' or phash_distance <= 2")
    return star_components(e.select(C("left_record_id").alias("u"), C("right_record_id").alias("v")))


@query("st8_idempotent_upsert", """SELECT image_id, count(*) AS deliveries, count(DISTINCT width || 'x' || height) > 1 AS conflict FROM processed_records WHERE image_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def st8(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "processed_records").filter("image_id is not null")
    size = F.concat(C("width").cast("string"), F.lit("x"), C("height").cast("string"))
    return p.groupBy("image_id").agg(N().alias("deliveries"), (F.count_distinct(size) > 1).alias("conflict")).filter("deliveries > 1")


@query("st8_upsert", """WITH x AS (SELECT record_id, max(image_path) AS image_path FROM audit_yolo_detection_dataset WHERE record_id IS NOT NULL GROUP BY 1) SELECT * FROM x""")
def st8b(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_yolo_detection_dataset").filter("record_id is not null").select("record_id", "image_path")
    return upsert(a.filter("record_id % 3 = 0"), a, "record_id")


@query("st6_related_groups")
def st6b(s: SparkSession, d: str) -> DataFrame:
    """Groups of records of equal content, asset or video or with near hashes, numbered by the least path of each."""
    a = table(s, d, "audit_yolo_detection_dataset").filter("record_id is not null")
    return related_groups(a.select("record_id", "image_path", "image_sha256", "phash"), 2)


@query("sm2_negative_subsample", f"""WITH {V.INSTANCES_SQL}, r AS (SELECT i.image_id, count(n.image_id) = 0 AS negative FROM images i LEFT JOIN instances n ON n.image_id = i.image_id GROUP BY 1),
p AS (SELECT round_even(count(*) * 0.005, 0) AS n FROM r WHERE NOT negative), q AS (SELECT *, row_number() OVER (PARTITION BY negative ORDER BY sha256('1337:' || image_id), image_id) AS k FROM r)
SELECT image_id, negative FROM q WHERE NOT negative OR k <= (SELECT n FROM p)""")
def sm2(s: SparkSession, d: str) -> DataFrame:
    has = V.instances(s, d).select("image_id", F.lit(False).alias("negative")).distinct()
    r = V.images(s, d).select("image_id").join(has, "image_id", "left").withColumn("negative", F.coalesce("negative", F.lit(True)))
    return S.negative_subsample(r, "negative", "image_id", 0.005, 1337)


@query("sm3_validation_groups", """WITH g AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS r, count(*) OVER () AS gs, sum(n) OVER () AS total FROM g WINDOW w AS (ORDER BY sha256('9:' || grp), grp ROWS UNBOUNDED PRECEDING))
SELECT grp, n, CASE WHEN upto - n < greatest(1, round_even(total * 0.2, 0)) AND r < gs THEN 'val' ELSE 'train' END AS split FROM r""")
def sm3(s: SparkSession, d: str) -> DataFrame:
    return S.validation_groups(table(s, d, "orders").select(C("o_custkey").alias("grp")), "grp", 0.2, 9)


@query("sm4_balanced_groups", """WITH RECURSIVE g AS (SELECT o_custkey::VARCHAR AS grp, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
t AS (SELECT round_even(sum(n) * 0.15::DOUBLE, 0) AS t, sum(n) AS total FROM g), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('5:' || grp)) AS k FROM g),
c AS (SELECT o.*, greatest(t.t, 1) AS tt, greatest(t.total - 2 * t.t, 1) AS tr FROM o, t),
r AS (SELECT 0::BIGINT AS k, 0::DOUBLE AS test, 0::DOUBLE AS val, 0::DOUBLE AS train, NULL::VARCHAR AS split
  UNION ALL SELECT k, test + n * (s = 'test')::INT, val + n * (s = 'val')::INT, train + n * (s = 'train')::INT, s FROM (SELECT c.k, c.n, r.test, r.val, r.train,
    list_sort([{'f': r.test / c.tt, 'h': sha256('5:' || c.grp || ':test'), 's': 'test'}, {'f': r.val / c.tt, 'h': sha256('5:' || c.grp || ':val'), 's': 'val'}, {'f': r.train / c.tr, 'h': sha256('5:' || c.grp || ':train'), 's': 'train'}])[1].s AS s FROM r JOIN c ON c.k = r.k + 1))
SELECT c.grp, c.n, r.split FROM r JOIN c USING (k)""")
def sm4(s: SparkSession, d: str) -> DataFrame:
    return S.balanced_groups(table(s, d, "orders").select(C("o_custkey").alias("grp")), "grp", 5, 0.15, 0.15)


@query("sm7_visible_instances", f"""WITH {V.INSTANCES_SQL} SELECT image_id, instance_id FROM instances WHERE greatest(least(x0 + w, width // 2) - greatest(x0, 0), 0) * greatest(least(y0 + h, height // 2) - greatest(y0, 0), 0) >= 0.3 * w * h""")
def sm7(s: SparkSession, d: str) -> DataFrame:
    from ..functions import geometry as G

    crop = (F.lit(0), F.lit(0), F.floor(C("width") / 2), F.floor(C("height") / 2))
    seen = G.overlap_area(G.corners(C("x0"), C("y0"), C("w"), C("h")), crop)
    return V.instances(s, d).filter(seen >= 0.3 * C("w") * C("h")).select("image_id", "instance_id")


@query("pf21_unknown_names", "SELECT DISTINCT attr_id FROM sample_targets WHERE attr_id NOT IN (SELECT attr_id FROM class_map WHERE family = 'visual')")
def pf21(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "class_map").filter("family = 'visual'").select("attr_id")
    return table(s, d, "sample_targets").select("attr_id").distinct().join(known, "attr_id", "left_anti")


@query("wn11_ecdf", "SELECT DISTINCT l_quantity AS v, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS share FROM lineitem")
def wn11(s: SparkSession, d: str) -> DataFrame:
    """From counts of distinct values, so that the running sum goes over few rows and never over all."""
    from ..operators.ordering import running_totals

    counts = table(s, d, "lineitem").groupBy(C("l_quantity").alias("v")).agg(N().alias("n")).withColumn("one", F.lit(1))
    run = running_totals(counts, "one", [C("v")], {"upto": "n"})
    total = counts.agg(F.sum("n")).first()[0]
    return run.select("v", F.round(C("upto") / F.lit(total), 9).alias("share"))
