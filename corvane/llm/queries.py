"""Queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import groups, leaks, mixing, overlaps, sampling, sentences, splits


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_safe_splits(table(spark, d, "audit_yolo_detection_dataset"), table(spark, d, "split_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).filter("crosses").select("record_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split a record and plan."""
    return _splits(spark, d).select("record_id", "component", F.explode("splits").alias("s")).select("s.plan_id", "record_id", "component", "s.split")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_splits(spark, d), table(spark, d, "audit_yolo_detection_dataset"), table(spark, d, "split_targets"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.proportional_sample(*(table(spark, d, t) for t in ("processed_records", "class_map", "sample_targets")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].filter("short").select("plan_id", "attr_id")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.consolidate_matches(table(spark, d, "audit_yolo_detection_dataset"), table(spark, d, "phash_matches"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("group_size > 1").select("group_root", "record_id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group, lone records included."""
    return _groups(spark, d)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split_overlaps(table(spark, d, "same_release_split_leakage_audit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_image_id", "image_id").alias("left_image_id"), F.greatest("train_image_id", "image_id").alias("right_image_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_counts(table(spark, d, "same_release_split_leakage_audit"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each contaminated document with the items that leaked into it."""
    return _leaks(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.max("run").alias("longest_run"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, d), table(spark, d, "eval_passages"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("short").select("mix_id", "source")


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_targets(spark: SparkSession, d: str) -> DataFrame:
    """What each source was to give and whether it did, to a thousandth or to a document."""
    report = _mix(spark, d)[1]
    near = F.abs(F.col("got_tokens") - F.col("want_tokens")) <= F.greatest(F.col("want_tokens") / 1000, F.lit(500))
    return report.select("mix_id", "source", "want_tokens", "short", (near & ~F.col("short")).alias("met"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "start_char", "end_char")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
