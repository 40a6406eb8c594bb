"""The shared input views, derived from the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

# The nine class names used to key thresholds, by class id.
CLASSES = {
    1: "face", 2: "person", 3: "plate", 4: "handwriting", 5: "signature", 6: "name", 7: "landmark", 8: "date", 9: "address",
}
PROVIDERS = ("maskrcnn", "yunet", "plate_yunet", "zxingcpp")


def images(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    width, height = (480 + (key * 37) % 1600).cast("int"), (360 + (key * 53) % 1200).cast("int")
    df = table(spark, d, "orders").select(
        key.alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "train2017").when(F.col("o_orderstatus") == "O", "val2017").otherwise("test2017").alias("split"),
        F.when(F.col("o_custkey") % 2 == 0, "general").otherwise("india").alias("domain"),
        width.alias("width"), height.alias("height"),
        F.when(key % 97 != 0, F.concat(F.lit("images/"), key.cast("string"), F.lit(".jpg"))).alias("image_path"),
    )
    odd = lambda a, b: F.when(F.col("image_id") % 11 == 0, b).when(F.col("image_id") % 13 == 0, F.lit(700)).otherwise(2 * a)
    return df.withColumns({"decoded_width": odd(F.col("width"), F.col("height")).cast("int"), "decoded_height": odd(F.col("height"), F.col("width")).cast("int")})


def instances(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    df = lines.withColumn("instance_id", number).join(images(spark, d).select("image_id", "split", "domain", "width", "height"), F.col("l_orderkey") == F.col("image_id"))
    q = F.floor("l_quantity")
    return df.select(
        "image_id", "instance_id", "split", "domain", "width", "height",
        (1 + F.col("l_partkey") % 9).cast("int").alias("class_id"),
        ((F.col("l_partkey") * 17) % (F.col("width") - 400)).cast("int").alias("x0"),
        ((F.col("l_suppkey") * 29 + F.col("l_linenumber") * 71) % (F.col("height") - 340)).cast("int").alias("y0"),
        (8 + 6 * q).cast("int").alias("w"), (8 + 5 * q).cast("int").alias("h"),
        "l_partkey", "l_suppkey", "l_discount", "l_returnflag",
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    df = instances(spark, d).filter("l_returnflag <> 'N'")
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    score = (100 - 8 * F.round(100 * F.col("l_discount")) - F.col("l_suppkey") % 5) / F.lit(100.0).cast("double")
    return df.select(
        F.concat_ws("-", F.lit("ev"), "image_id", "instance_id").alias("evidence_id"), "image_id", provider.alias("provider"),
        score.alias("confidence"),
        F.greatest(F.lit(0), F.col("x0") + 2 * (F.col("l_partkey") % 7 - 3)).cast("int").alias("x0"),
        F.greatest(F.lit(0), F.col("y0") + 2 * (F.col("l_suppkey") % 5 - 2)).cast("int").alias("y0"),
        "w", "h", "width", "height", "class_id", "split",
    )


def hashes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    base = F.conv(F.substring(F.md5(F.floor(i / 4).cast("string")), 1, 15), 16, 10).cast("bigint")
    flip = lambda bits, m: F.expr(f"shiftleft(CAST({bits} AS BIGINT), CAST(c_custkey % {m} AS INT))")
    mask = F.when(i % 4 == 1, flip(1, 59)).when(i % 4 == 2, flip(7, 57)).when(i % 4 == 3, flip(2047, 49)).otherwise(F.lit(0).cast("bigint"))
    split = F.element_at(F.array(F.lit("train2017"), F.lit("val2017"), F.lit("test2017")), (i % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(i.alias("item_id"), base.bitwiseXOR(mask).alias("h"), split.alias("split"))


IMAGES_SQL = """
im0 AS (
  SELECT o_orderkey AS image_id,
    CASE o_orderstatus WHEN 'F' THEN 'train2017' WHEN 'O' THEN 'val2017' ELSE 'test2017' END AS split,
    CASE WHEN o_custkey % 2 = 0 THEN 'general' ELSE 'india' END AS domain,
    CAST(480 + (o_orderkey * 37) % 1600 AS INT) AS width, CAST(360 + (o_orderkey * 53) % 1200 AS INT) AS height,
    CASE WHEN o_orderkey % 97 <> 0 THEN 'images/' || o_orderkey || '.jpg' END AS image_path
  FROM orders),
images AS (
  SELECT *,
    CAST(CASE WHEN image_id % 11 = 0 THEN height WHEN image_id % 13 = 0 THEN 700 ELSE 2 * width END AS INT) AS decoded_width,
    CAST(CASE WHEN image_id % 11 = 0 THEN width WHEN image_id % 13 = 0 THEN 700 ELSE 2 * height END AS INT) AS decoded_height
  FROM im0)"""

INSTANCES_SQL = IMAGES_SQL + """,
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS instance_id FROM lineitem),
instances AS (
  SELECT i.image_id, CAST(li.instance_id AS INT) AS instance_id, i.split, i.domain, i.width, i.height,
    CAST(1 + l_partkey % 9 AS INT) AS class_id,
    CAST((l_partkey * 17) % (width - 400) AS INT) AS x0, CAST((l_suppkey * 29 + l_linenumber * 71) % (height - 340) AS INT) AS y0,
    CAST(8 + 6 * floor(l_quantity) AS INT) AS w, CAST(8 + 5 * floor(l_quantity) AS INT) AS h,
    l_partkey, l_suppkey, l_discount, l_returnflag
  FROM li JOIN images i ON i.image_id = l_orderkey)"""

EVIDENCE_SQL = INSTANCES_SQL + """,
evidence AS (
  SELECT 'ev-' || image_id || '-' || instance_id AS evidence_id, image_id,
    (['maskrcnn', 'yunet', 'plate_yunet', 'zxingcpp'])[CAST(l_suppkey % 4 + 1 AS INT)] AS provider,
    (100 - 8 * round(100 * l_discount) - l_suppkey % 5) / CAST(100 AS DOUBLE) AS confidence,
    CAST(greatest(0, x0 + 2 * (l_partkey % 7 - 3)) AS INT) AS x0, CAST(greatest(0, y0 + 2 * (l_suppkey % 5 - 2)) AS INT) AS y0,
    w, h, width, height, class_id, split
  FROM instances WHERE l_returnflag <> 'N')"""

HASHES_SQL = """
hashes AS (
  SELECT c_custkey AS item_id, (['train2017', 'val2017', 'test2017'])[CAST(c_custkey % 3 + 1 AS INT)] AS split,
    xor(CAST('0x' || substr(md5(CAST(c_custkey // 4 AS VARCHAR)), 1, 15) AS BIGINT),
      CASE c_custkey % 4 WHEN 1 THEN 1::BIGINT << (c_custkey % 59)::INT WHEN 2 THEN 7::BIGINT << (c_custkey % 57)::INT
        WHEN 3 THEN 2047::BIGINT << (c_custkey % 49)::INT ELSE 0 END) AS h
  FROM customer)"""
