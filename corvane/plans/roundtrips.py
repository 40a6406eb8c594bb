"""Queries that write a table through a sink and read it back through its source, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, table
from ..sources import files as S
from .registry import query

C = F.col


def _place(s: SparkSession) -> str:
    return f"{scratch_dir(s, 'corvane-files')}/data"


@query("sc1_sk1_jsonl", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def sc1(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    S.write_jsonl(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return S.read_jsonl(s, at, "c_custkey bigint, c_name string, c_acctbal double")


@query("sc2_malformed_lines", "SELECT count(*) FILTER (c_custkey % 10 <> 0) AS good, count(*) FILTER (c_custkey % 10 = 0) AS bad FROM customer")
def sc2(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    line = F.to_json(F.struct("c_custkey", "c_name"))
    lines = table(s, d, "customer").select(F.when(C("c_custkey") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    lines.write.text(at)
    good, bad = S.read_jsonl_with_errors(s, at, "c_custkey bigint, c_name string")
    both = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return both.agg(F.count_if(C("g") == 1).alias("good"), F.count_if(C("g") == 0).alias("bad"))


@query("sc4_json_array", "SELECT n_nationkey, n_name FROM nation")
def sc4(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    # one file an array, an array a region
    whole = table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.repartition(64, "n_regionkey").write.partitionBy("n_regionkey").text(at)
    parts = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at)
    return S.read_json_arrays_of(parts, "n_nationkey int, n_name string")


@query("sc5_sk3_csv", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal FROM supplier")
def sc5(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    S.write_csv(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at)
    return S.read_csv(s, at, "s_suppkey string, s_name string, s_acctbal double")


@query("sk2_split_jsonl", "SELECT o_orderstatus AS split, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def sk2(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    S.write_split_jsonl(table(s, d, "orders").select(C("o_orderstatus").alias("split"), "o_orderkey"), at, "split", "o_orderkey")
    back = s.read.schema("o_orderkey bigint, split string").json(at)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("sk4_event_log", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def sk4(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    rows = table(s, d, "events").select(F.unix_timestamp(C("ts").cast("timestamp")).cast("double").alias("time_unix"), C("event_type").alias("event"), C("event_id"))
    for half in (0, 1):
        S.append_events(rows.filter(C("event_id") % 2 == half).drop("event_id"), at)
    return s.read.schema("time_unix double, event string").json(at).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("sc7_yaml_rules", "SELECT * FROM (VALUES ('maskrcnn', 'face', 0.6::DOUBLE, 1024, 0.12::DOUBLE), ('*', '*', 0.5::DOUBLE, 256, 0.25::DOUBLE)) r(provider, class_name, score, min_area, max_fraction)")
def sc7(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    lines = ["profile_id: p1", "rules:", "- {provider: maskrcnn, class_name: face, score: 0.6, min_area: 1024, max_fraction: 0.12}", "- {provider: '*', class_name: '*', score: 0.5, min_area: 256, max_fraction: 0.25}"]
    s.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(at)
    return S.read_rules(s, at)


@query("sc9_wider_blocks", """SELECT 'r' || n_regionkey || '/' || n_nationkey || '.jpg' AS image, (n_nationkey % 3)::BIGINT AS boxes, CASE WHEN n_nationkey % 3 > 0 THEN (10 + n_nationkey)::DOUBLE END AS first_width FROM nation""")
def sc9(s: SparkSession, d: str) -> DataFrame:
    """A file a region of blocks of name, count and as many boxes, a count of 0 being followed by a row of zeros."""
    n, k = table(s, d, "nation"), C("n_nationkey") % 3
    row = F.concat_ws(" ", F.lit("1 2"), (C("n_nationkey") + 10).cast("string"), F.lit("30 0 0 0 0 0 0"))
    boxes = F.when(k == 0, F.lit("0 0 0 0 0 0 0 0 0 0")).otherwise(F.array_join(F.array_repeat(row, k.cast("int")), "\n"))
    block = F.concat_ws("\n", F.concat(F.lit("r"), C("n_regionkey").cast("string"), F.lit("/"), C("n_nationkey").cast("string"), F.lit(".jpg")), k.cast("string"), boxes)
    files = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("text"))
    found = S.parse_wider(files)
    return found.select("image", F.size("boxes").cast("bigint").alias("boxes"), F.get(F.get("boxes", F.lit(0)), F.lit(2)).alias("first_width"))


@query("sc17_inventory", "SELECT p_brand AS kind, count(*) AS n FROM part GROUP BY 1")
def sc17(s: SparkSession, d: str) -> DataFrame:
    at = _place(s)
    lines = table(s, d, "part").select(F.concat_ws("\t", "p_name", "p_brand").alias("value"))
    lines.unionByName(s.createDataFrame([("name\tkind",), ("no tab here",)], "value string")).write.text(at)
    return S.inventory_counts(s, at)
