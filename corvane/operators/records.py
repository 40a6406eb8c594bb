"""Record preparation: projection, routing, validation and threshold lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.hashing import asset_key, video_group
from ..session import cut
from ..skew import lookup_join
from .components import star_components
from .ordering import global_rank
from .similarity import near_hash_pairs

#: A rules table has one row for each (provider, class) pair a caller configures; larger ones are refused.
MAX_RULES = 10_000


def first_true(*cases: tuple[str, Column]) -> Column:
    """Name of the first condition that holds, null conditions counting as false; null if none does."""
    out = None
    for name, cond in cases:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def project_class(records: DataFrame, class_id: int) -> DataFrame:
    """Only the instances of one class, renumbered to 1; ``negative_for_profile`` where none is left. Null instances are dropped."""
    kept = F.filter(F.coalesce("instances", F.lit(None)), lambda i: i["class_id"] == class_id)
    df = records.withColumn("instances", F.transform(kept, lambda i: i.withField("class_id", F.lit(1))))
    return df.withColumn("negative_for_profile", F.coalesce(F.size("instances"), F.lit(0)) < 1)


def selection_outcome(selected: Column, valid: Column) -> Column:
    """``negative`` if nothing was selected, ``omit`` if all that was selected failed, else ``keep``."""
    return F.when(selected == 0, "negative").when(valid == 0, "omit").otherwise("keep")


def _polygon_error(p: Column, width: Column, height: Column) -> Column:
    bad = lambda f: F.exists(p, f)
    outside = F.exists(F.transform(p, lambda v, i: (v < 0) | (v >= F.when(i % 2 == 0, width).otherwise(height))), lambda x: x)
    return first_true(
        ("invalid_polygon_length", p.isNull() | (F.size(p) < 6) | (F.size(p) % 2 == 1)),
        ("non_numeric_polygon", bad(lambda v: v.isNull())),
        ("non_finite_polygon", bad(lambda v: F.isnan(v) | (F.abs(v) == float("inf")))),
        ("polygon_out_of_bounds", outside),
    )


def instance_error(i: Column, width: Column, height: Column, class_ids: list[int]) -> Column:
    """First fault of one instance in the fixed order of checks; null for a sound one."""
    box, polygons = i["bbox"], i["polygons"]
    at = lambda k: F.get(box, F.lit(k))
    x, y, w, h = (at(k) for k in range(4))
    malformed = i.isNull() | i["class_id"].isNull() | box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull())
    in_polygons = F.get(F.filter(F.transform(polygons, lambda p: _polygon_error(p, width, height)), lambda e: e.isNotNull()), F.lit(0))
    before = first_true(
        ("malformed_instance", malformed),
        ("unknown_class_id", ~i["class_id"].isin(class_ids)),
        ("non_finite_bbox", F.exists(box, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))),
        ("invalid_bbox_area", (w <= 0) | (h <= 0)),
        ("bbox_out_of_bounds", (x < 0) | (y < 0) | (x + w > width + 0.01) | (y + h > height + 0.01)),
        ("missing_polygons", polygons.isNull() | (F.size(polygons) == 0)),
    )
    flat = F.when(~F.exists(polygons, lambda p: G.polygon_area(p) > 0), "zero_area_polygons")
    return F.coalesce(before, in_polygons, flat)


def delivery_errors(split: Column, image_split: Column, expected: Column, path: Column, project: str, images: str, known: Column) -> Column:
    """First fault of a record as it was delivered: its splits against the one its file is named after, its image's path and file.

    ``images`` is the folder of the release below ``project``, with a folder a
    split; a relative path is below the project, and one that climbs out of it is
    outside. ``known`` tells whether the file is there.
    """
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(project.rstrip("/") + "/"), path))
    climbs = F.regexp_like(whole, F.lit(r"(^|/)\.\.(/|$)"))
    folder = F.concat(F.lit(f"{project.rstrip('/')}/{images}/"), expected, F.lit("/"))
    return first_true(
        ("record_split_does_not_match_filename", ~split.eqNullSafe(expected)),
        ("record_image_split_does_not_match_annotation_split", ~image_split.eqNullSafe(expected)),
        ("image_path_outside_project", path.isNotNull() & (climbs | ~whole.startswith(project.rstrip("/") + "/"))),
        ("image_path_outside_same_release_split", path.isNotNull() & ~F.startswith(whole, folder)),
        ("image_file_missing", path.isNotNull() & ~known),
    )


def json_lines_errors(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` (file, line_no, raw) with ``record`` under ``schema`` and ``error``, ``invalid_json`` where the line is no JSON object; blank lines are left out."""
    read = lines.filter(F.trim("raw") != "").withColumn("record", F.from_json("raw", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    return read.select("*", F.when(bad, "invalid_json").alias("error"))


def geometry_contract(width: Column, height: Column, box: tuple[Column, ...], polygon: Column, runs: Column) -> Column:
    """First fault of a region: ``bad_size``, ``outside`` or ``empty_box`` (corners x0, y0, x1, y1), ``too_few_points``, ``run_lengths``; null parts are not checked."""
    x0, y0, x1, y1 = box
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return first_true(
        ("bad_size", (width < 1) | (height < 1)), ("empty_box", (x1 <= x0) | (y1 <= y0)), ("outside", (x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height)),
        ("too_few_points", (F.size(polygon) < 6) & polygon.isNotNull()), ("run_lengths", (total != width.cast("bigint") * height) | F.exists(runs, lambda r: r < 0)),
    )


def validate_records(records: DataFrame, class_ids: list[int], release: str) -> DataFrame:
    """``records`` with ``error``, the first fault of the record or of its first faulty instance, and ``sound``,
    the number of instances before that one (all of them where the record is sound, none where the record itself fails)."""
    record = first_true(
        ("record_image_release", F.coalesce(F.col("image_release") != release, F.lit(True))),
        ("record_geometry_is_not_verified", F.col("geometry_status").isNotNull() & (F.col("geometry_status") != "aligned_resize")),
        ("missing_or_invalid_required_field", F.col("image_path").isNull() | F.col("width").isNull() | F.col("height").isNull()),
        ("invalid_dimensions_or_instances", (F.col("width") < 1) | (F.col("height") < 1) | F.col("instances").isNull()),
        ("empty_instances_without_negative_marker", (F.size("instances") == 0) & ~F.coalesce("negative_for_profile", F.lit(False))),
    )
    faults = F.transform("instances", lambda i: instance_error(i, F.col("width"), F.col("height"), class_ids))
    df = records.withColumn("_record", record).withColumn("_faults", F.when(F.col("_record").isNull(), faults))
    first = F.get(F.filter(F.transform("_faults", lambda e, k: F.struct(e.alias("e"), k.alias("k"))), lambda s: s["e"].isNotNull()), F.lit(0))
    df = df.withColumn("_first", first)
    sound = F.coalesce(F.col("_first.k"), F.size("_faults"), F.lit(0))
    return df.withColumn("error", F.coalesce("_record", F.col("_first.e"))).withColumn("sound", F.greatest(sound, F.lit(0)).cast("int")).drop("_record", "_faults", "_first")


def threshold_lookup(items: DataFrame, rules: DataFrame, provider: str = "provider", name: str = "class_name") -> DataFrame:
    """``items`` with the rule of (provider, class) or, failing that, (provider, *), (*, class), (*, *); nulls where none fits.

    Four lookups on a broadcast of the caller's rules, whose number is checked; a
    repeated (provider, class) is an error.
    """
    keys = rules.groupBy("provider", "class_name").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if (keys[1] or 0) > 1:
        raise ValueError("two rules for one provider and class")
    if keys[0] > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fields = [c for c in rules.columns if c not in ("provider", "class_name")]
    out = items
    for k, (p, c) in enumerate(((provider, name), (provider, None), (None, name), (None, None))):
        r = rules.filter((F.col("provider") == "*") == (p is None)).filter((F.col("class_name") == "*") == (c is None))
        r = r.select(F.col("provider").alias("_p"), F.col("class_name").alias("_c"), F.struct(*fields).alias(f"_r{k}"))
        on = (F.lit(True) if p is None else out[p] == r["_p"]) & (F.lit(True) if c is None else out[c] == r["_c"])
        out = out.join(F.broadcast(r), on, "left").drop("_p", "_c")
    rule = F.coalesce(*(f"_r{k}" for k in range(4)))
    return out.withColumn("_rule", rule).select(*items.columns, *(F.col(f"_rule.{f}").alias(f) for f in fields))


def reject_reason(score: Column, area: Column, image_area: Column) -> Column:
    """Why a threshold rule's columns score, min_area and max_fraction reject an item; null if they do not."""
    return first_true(
        ("score", score < F.col("score")), ("min_area", area < F.col("min_area")), ("area_fraction", area / image_area > F.col("max_fraction")),
    )


def keep_best(rows: DataFrame, key: str, size: str, ident: str) -> DataFrame:
    """``rows`` with ``kept`` and ``most``: whether a row has the greatest ``size`` of its ``key``, of equals the least ``ident``, and that size.

    The best of each key is aggregated before any shuffle and looked up, so a key
    of any size is never sorted in one task. Rows with a null key are kept.
    """
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(size).alias("most"), F.min_by(ident, F.struct(-F.col(size), ident)).alias("_best"))
    found = lookup_join(rows, best, key)
    return found.withColumn("kept", F.col(key).isNull() | (F.col(ident) == F.col("_best"))).drop("_best")


def quarantine(records: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``records`` without those whose ``key`` is listed; a listed key that no record has is an error."""
    absent = [r[key] for r in listed.select(key).filter(F.col(key).isNotNull()).join(records.select(key), key, "left_anti").distinct().limit(5).collect()]
    if absent:
        raise ValueError(f"listed but absent: {absent}")
    return records.join(listed.select(key).distinct(), key, "left_anti")


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict) of each row of ``manifest`` (path, bytes, sha256) against ``files`` (path, content), as a binary file scan gives them.

    verdict: ``missing``, ``size_differs``, ``digest_differs`` or ``ok``; letter case of the digest does not count.
    """
    found = files.select("path", F.octet_length("content").alias("_bytes"), F.sha2("content", 256).alias("_sha256"))
    verdict = first_true(
        ("missing", F.col("_bytes").isNull()), ("size_differs", F.col("_bytes") != F.col("bytes")),
        ("digest_differs", F.col("_sha256") != F.lower("sha256")), ("ok", F.lit(True)),
    )
    return manifest.join(found, "path", "left").select("path", verdict.alias("verdict"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``incoming`` whose key it lacks, one row a key.

    To deliver a row again changes nothing; the same key with another payload is
    an error, raised where the rows are computed. Rows without a key are left out.
    """
    payload = [c for c in existing.columns if c != key]
    rows = existing.unionByName(incoming.select(existing.columns)).filter(F.col(key).isNotNull())
    digest = F.xxhash64(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    one = rows.withColumn("_d", digest).groupBy(key).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.first(F.struct(*payload)).alias("_p"))
    same = F.when(F.col("_lo") == F.col("_hi"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("two payloads for "), F.col(key).cast("string"))).cast(one.schema[key].dataType))
    return one.select(same.alias(key), "_p.*").select(existing.columns)


def related_groups(records: DataFrame, max_distance: int) -> DataFrame:
    """(record_id, group_no, group_size): groups of ``records`` (record_id, image_path, image_sha256, phash), numbered from 1 by their least path.

    Records are related, directly or through others, by an equal image_sha256, by
    the asset or the video that image_path names, and by phash values at most
    ``max_distance`` bits apart; nulls and empty names relate nothing. Each value is
    a hub that its least record is linked to, so no list of pairs grows with a hot
    value; repeated rows of a record count once.
    """
    x = cut(
        records.groupBy("record_id").agg(F.min("image_path").alias("image_path"), F.max("image_sha256").alias("sha"), F.max("phash").alias("h"))
        .withColumn("asset", F.nullif(asset_key(F.col("image_path")), F.lit(""))).withColumn("video", F.nullif(video_group(F.col("image_path")), F.lit("")))
    )
    keys = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in ("sha", "asset", "video", "h"))))
    members = x.select("record_id", F.explode(keys).alias("hub"))
    hubs = members.groupBy("hub").agg(F.min("record_id").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub", "v")
    links = lookup_join(members, hubs, "hub", "inner").select(F.col("record_id").alias("u"), "v")
    ends = x.filter("h is not null").groupBy("h").agg(F.min("record_id").alias("r"))
    near = near_hash_pairs(x, x, max_distance).filter("g < h").join(ends.toDF("g", "u"), "g").join(ends.toDF("h", "v"), "h").select("u", "v")
    roots = star_components(links.unionByName(near)).withColumnRenamed("vertex", "record_id")
    grouped = x.select("record_id", "image_path").join(roots, "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
    groups = grouped.groupBy("root").agg(F.min("image_path").alias("path"), F.count(F.lit(1)).alias("group_size"))
    ranked = global_rank(groups, [F.col("path").asc_nulls_last(), F.col("root")], "group_no")
    return lookup_join(grouped.select("record_id", "root"), ranked.select("root", "group_no", "group_size"), "root", "inner").select("record_id", "group_no", "group_size")
