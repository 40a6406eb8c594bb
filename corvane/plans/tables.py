"""Named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import nested
from ..session import scratch_dir, table
from ..sources import files, label_export
from ..streaming import events
from . import views as V
from .registry import query


_CELL = '"(?:[^"]|"")*"|[^",]*'
_NUM = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
_P5_SQL = rf"""
WITH t AS (SELECT raw_id, regexp_replace(coalesce(raw, ''), '\r$', '') AS s FROM yolo_label_export),
c AS (SELECT raw_id, regexp_matches(s, '(?s)^({_CELL})(,({_CELL}))*$') AS quoted,
  list_transform(regexp_extract_all(',' || s, '(?s),({_CELL})', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM t),
r AS (SELECT raw_id, c, CASE WHEN NOT quoted THEN 0 WHEN len(c) <> 8 THEN 1 WHEN NOT regexp_matches(c[2], '^[0-9]*[1-9][0-9]*$') OR NOT regexp_matches(c[3], '^[0-9]*[1-9][0-9]*$') THEN 2
  WHEN NOT regexp_matches(c[7], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$') OR TRY_CAST(replace(replace(c[7], 'T', ' '), 'Z', '') AS TIMESTAMP) IS NULL THEN 3 END AS row_fault FROM c),
b AS (SELECT raw_id, TRY_CAST(c[2] AS DOUBLE) AS pw, TRY_CAST(c[3] AS DOUBLE) AS ph, unnest(list_transform(string_split(c[4], ';'), lambda x: CASE WHEN trim(x, ' \t') = '' THEN [] ELSE string_split_regex(trim(x, ' \t'), '[ \t]+') END)) AS v
  FROM r WHERE row_fault IS NULL AND NOT regexp_matches(c[4], '^\s*$')),
n AS (SELECT *, list_transform(v, lambda x: CASE WHEN regexp_matches(x, '{_NUM}') THEN TRY_CAST(x AS DOUBLE) END) AS n, len(list_filter(v, lambda x: NOT regexp_matches(x, '{_NUM}') AND NOT regexp_matches(lower(x), '^[+-]?(nan|inf|infinity)$'))) AS words FROM b),
f AS (SELECT raw_id, CASE WHEN len(v) <> 5 THEN 4 WHEN words > 0 THEN 5 WHEN len(list_filter(n, lambda x: x IS NOT NULL AND isfinite(x))) < 5 THEN 6
  WHEN n[1] < 0 OR n[1] <> round(n[1]) THEN 7 WHEN n[2] < 0 OR n[2] > 1 OR n[3] < 0 OR n[3] > 1 OR n[4] <= 0 OR n[4] > 1 OR n[5] <= 0 OR n[5] > 1 THEN 8
  WHEN n[2] - n[4] / 2 < 0 OR n[2] + n[4] / 2 > 1 OR n[3] - n[5] / 2 < 0 OR n[3] + n[5] / 2 > 1 THEN 9 WHEN n[4] * pw <= 1 OR n[5] * ph <= 1 THEN 10 END AS fault FROM n),
m AS (SELECT raw_id, min(fault) AS fault FROM f GROUP BY 1)
SELECT r.raw_id, (['{"', '".join(label_export.REASONS)}'])[1 + coalesce(row_fault, fault)] AS reason FROM r LEFT JOIN m USING (raw_id) WHERE coalesce(row_fault, fault) IS NOT NULL"""

_P6_SQL = """
WITH a AS (SELECT 'processed_records' AS source_table, row_id, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM processed_records),
ap AS (SELECT source_table, row_id, k, i.polygons AS ps FROM a WHERE i IS NOT NULL),
app AS (SELECT source_table, row_id, k, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS j FROM ap),
d AS (SELECT payload_id AS row_id, payload::JSON AS d FROM record_payloads),
h AS (SELECT row_id, coalesce(nullif(d -> '$.instances', 'null'), nullif(d -> '$.record.annotations.instances', 'null'), nullif(d -> '$.annotations[0].instances', 'null')) AS n FROM d),
l AS (SELECT row_id, CASE json_type(n) WHEN 'ARRAY' THEN list_transform(range(0, json_array_length(n)::BIGINT), lambda q: json_extract(n, '$[' || q || ']')) WHEN 'OBJECT' THEN list_transform(json_keys(n), lambda q: json_extract(n, '$."' || q || '"')) END AS l FROM h),
b AS (SELECT 'record_payloads' AS source_table, row_id, unnest(l) AS i, generate_subscripts(l, 1) - 1 AS k FROM l),
bp AS (SELECT source_table, row_id, k, json_extract(i, '$.polygons') AS n FROM b WHERE json_type(i) = 'OBJECT'),
bl AS (SELECT *, CASE WHEN json_type(n) <> 'ARRAY' THEN NULL WHEN json_type(n -> '$[0]') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN [n] ELSE list_transform(range(0, json_array_length(n)::BIGINT), lambda q: json_extract(n, '$[' || q || ']')) END AS ps FROM bp),
bpp AS (SELECT source_table, row_id, k, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS j FROM bl),
poly AS (SELECT source_table, row_id, k, j FROM app WHERE len(list_filter(p, lambda v: v IS NOT NULL)) > 0
  UNION ALL SELECT source_table, row_id, k, j FROM bpp WHERE (json_type(p) = 'ARRAY' AND json_array_length(p) > 0) OR (json_type(p) = 'OBJECT' AND json_array_length(p -> '$.points') > 0)),
inst AS (SELECT source_table, row_id, k FROM ap UNION ALL SELECT source_table, row_id, k FROM bp),
rec AS (SELECT 'processed_records' AS source_table, row_id FROM processed_records UNION ALL SELECT 'record_payloads', payload_id FROM record_payloads)
SELECT source_table, row_id, k::INT AS instance_no, j::INT AS polygon_no FROM poly
UNION ALL SELECT source_table, row_id, k::INT, -1 FROM inst ANTI JOIN poly USING (source_table, row_id, k)
UNION ALL SELECT source_table, row_id, -1, -1 FROM rec ANTI JOIN inst USING (source_table, row_id)"""


def _export(spark: SparkSession, d: str) -> DataFrame:
    return label_export.read_label_export(table(spark, d, "yolo_label_export"))


@query("p5_found", _P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return label_export.rejected(_export(spark, d)).select("raw_id", "reason")


@query("p5_loaded")
def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return label_export.loaded(_export(spark, d))


@query("p5_rejected", f"SELECT raw_id, source_file, line_no, reason, raw FROM yolo_label_export JOIN ({_P5_SQL}) USING (raw_id)")
def p5_rejected(spark: SparkSession, d: str) -> DataFrame:
    return label_export.rejected(_export(spark, d))


_P6_POLYGONS = _P6_SQL[: _P6_SQL.index("poly AS (")] + """
f AS (SELECT source_table, row_id, k, j, len(p) AS n, len(list_filter(p, lambda v: v IS NOT NULL)) AS there FROM app
  UNION ALL SELECT source_table, row_id, k, j, CASE WHEN json_type(p) = 'OBJECT' THEN 2 * json_array_length(p -> '$.points') WHEN json_type(p -> '$[0]') IN ('ARRAY', 'OBJECT') THEN 2 * json_array_length(p) ELSE json_array_length(p) END, 1 FROM bpp WHERE json_type(p) IN ('ARRAY', 'OBJECT'))
SELECT source_table, row_id, k::INT AS instance_no, j::INT AS polygon_no, ((n + 1) // 2)::INT AS n_points FROM f WHERE n > 0 AND there > 0"""
_P6_RECORDS = _P6_SQL[: _P6_SQL.index("bp AS (")] + """
n AS (SELECT source_table, row_id, count(*) AS n FROM (SELECT source_table, row_id FROM ap UNION ALL SELECT source_table, row_id FROM b WHERE json_type(i) = 'OBJECT') GROUP BY 1, 2),
w AS (SELECT row_id, d, CASE WHEN json_type(d -> '$.record') = 'OBJECT' THEN d -> '$.record' ELSE d END AS b FROM d), m AS (SELECT *, CASE WHEN json_type(b -> '$.image') = 'OBJECT' THEN b -> '$.image' ELSE b END AS i FROM w),
z AS (SELECT *, coalesce(i -> '$.size', b -> '$.size') AS z FROM m),
r AS (SELECT 'processed_records' AS source_table, row_id, image_id, width, height, negative_for_profile FROM processed_records
  UNION ALL SELECT 'record_payloads', row_id, i ->> '$.image_id', (CASE json_type(z) WHEN 'OBJECT' THEN z ->> '$.width' WHEN 'ARRAY' THEN z ->> '$[0]' ELSE i ->> '$.width' END)::INT,
    (CASE json_type(z) WHEN 'OBJECT' THEN z ->> '$.height' WHEN 'ARRAY' THEN z ->> '$[1]' ELSE i ->> '$.height' END)::INT, (coalesce(d ->> '$.negative_for_profile', b ->> '$.negative_for_profile'))::BOOLEAN FROM z)
SELECT r.*, coalesce(n, 0)::INT AS n_instances FROM r LEFT JOIN n USING (source_table, row_id)"""
_P6 = {"places": _P6_SQL, "polygons": _P6_POLYGONS, "records": _P6_RECORDS}


def _nested(which: str) -> None:
    name = "p6_found" if which == "places" else f"p6_{which}"

    @query(name, _P6.get(which))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.both_sources(table(spark, d, "processed_records"), table(spark, d, "record_payloads"), which)


for _which in ("places", "records", "instances", "polygons", "points"):
    _nested(_which)


@query("sc3_map_entries", "SELECT event_id, k AS key, (props ->> k)::DOUBLE AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def sc3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, double>")).alias("key", "value"))


@query("sc6_parquet_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size > 40")
def sc6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size > 40").select("p_partkey", "p_brand")


@query("sc8_yolo_labels", """WITH l AS (SELECT record_id, width, height, unnest(boxes) AS b FROM (SELECT DISTINCT record_id, width, height, boxes FROM audit_yolo_detection_dataset WHERE width IS NOT NULL))
SELECT record_id, count(*) FILTER (ok) AS boxes, count(*) FILTER (NOT ok) AS errors FROM (SELECT record_id, b.center_x - b.width * 1.1::DOUBLE / 2 >= 0 AND b.center_x + b.width * 1.1::DOUBLE / 2 <= 1 AND b.width * 1.1::DOUBLE <= 1
  AND b.center_y - b.height / 2 >= 0 AND b.center_y + b.height / 2 <= 1 AND b.width * 1.1::DOUBLE * width > 1 AND b.height * height > 1 AS ok FROM l) GROUP BY 1""")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    line = lambda b: F.concat_ws(" ", b["class_id"].cast("string"), b["center_x"].cast("string"), b["center_y"].cast("string"), (b["width"] * 1.1).cast("string"), b["height"].cast("string"))
    a = table(spark, d, "audit_yolo_detection_dataset").filter("width is not null and size(boxes) > 0").dropDuplicates(["record_id"])
    parsed = files.parse_yolo_labels(a.select("record_id", "width", "height", F.array_join(F.transform("boxes", line), "\n").alias("text")))
    return parsed.select("record_id", F.size("boxes").cast("bigint").alias("boxes"), F.size("errors").cast("bigint").alias("errors"))


@query("sc10_ccpd_names", """WITH p AS (SELECT p_partkey, p_partkey % 300 AS x, p_size * 7 AS y FROM part) SELECT p_partkey, least(x, 280)::DOUBLE AS x, y::DOUBLE AS y, (least(x + 60, 280) - least(x, 280))::DOUBLE AS w, 30::DOUBLE AS h FROM p WHERE least(x + 60, 280) - least(x, 280) > 1""")
def sc10(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("p_partkey") % 300, F.col("p_size") * 7
    at = lambda a, b: F.concat_ws("&", a.cast("string"), b.cast("string"))
    name = F.concat(F.lit("025-90_0-1_2-"), F.concat_ws("_", at(x + 60, y + 30), at(x, y + 30), at(x, y), at(x + 60, y)), F.lit("-0_0.jpg"))
    box = files.parse_ccpd_name(name, F.lit(280), F.lit(2000))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).filter("b is not null").select("p_partkey", "b.x", "b.y", "b.w", "b.h")


@query("sc11_nested_lines", """WITH i AS (SELECT row_id, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS a FROM processed_records), p AS (SELECT row_id, a, unnest(i.polygons) AS p, generate_subscripts(i.polygons, 1) - 1 AS b FROM i WHERE coalesce(i.iscrowd, false) = false)
SELECT row_id, a::INT AS a, b::INT AS b, len(p)::INT // 2 AS points FROM p WHERE len(p) >= 6""")
def sc11(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "processed_records").select("row_id", F.posexplode("instances").alias("a", "i")).filter("not coalesce(i.iscrowd, false)")
    p = i.select("row_id", "a", F.posexplode("i.polygons").alias("b", "p")).filter("size(p) >= 6")
    return p.select("row_id", "a", "b", F.floor(F.size("p") / 2).cast("int").alias("points"))


@query("sc12_common_schema", """SELECT 'processed' AS source, image_id, width, height FROM processed_records WHERE width IS NOT NULL UNION ALL SELECT 'scan', images.image_id, width, height FROM same_release_split_leakage_audit WHERE width IS NOT NULL
UNION ALL SELECT 'audit', record_id::VARCHAR, width, height FROM audit_yolo_detection_dataset WHERE width IS NOT NULL""")
def sc12(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, source: str, key: str) -> DataFrame:
        return table(spark, d, name).filter("width is not null").select(F.lit(source).alias("source"), F.col(key).cast("string").alias("image_id"), "width", "height")

    frames = [one("processed_records", "processed", "image_id"), one("same_release_split_leakage_audit", "scan", "images.image_id"), one("audit_yolo_detection_dataset", "audit", "record_id")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("ud3_tiled_provider")
def ud3(spark: SparkSession, d: str) -> DataFrame:
    return providers.run_tiled(V.images(spark, d), providers.StubProvider(), tile_size=768, overlap=0.25, max_tiles=24)


@query("ud4_orchestrated_providers", f"WITH {V.IMAGES_SQL} SELECT image_id, p.provider, width / 4::DOUBLE AS x0, 3 * height / 4::DOUBLE AS y1 FROM images, (VALUES ('a'), ('b')) p(provider)")
def ud4(spark: SparkSession, d: str) -> DataFrame:
    found, _ = providers.orchestrate(V.images(spark, d), [providers.StubProvider("a"), providers.StubProvider("b")])
    return found.select("image_id", "provider", "x0", "y1")


@query("ss1_fixed_lifetime", "SELECT event_id, ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20 00:00:00' AS expired, ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20 00:00:00' AS due FROM events")
def ss1(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", events.access_expired(F.col("ts"), 7 * 86400, at).alias("expired"), events.cleanup_due(F.col("ts"), 7 * 86400, at).alias("due"))


@query("ss3_stream_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, count(*) AS n FROM events GROUP BY 1, 2")
def ss3(spark: SparkSession, d: str) -> DataFrame:
    counts = events.windowed_counts(events.stream_table(spark, d, "events"))
    return events.run_to_files(counts, scratch_dir(spark, "corvane-stream")).select("event_type", F.col("window.start").cast("string").alias("start"), "n")
