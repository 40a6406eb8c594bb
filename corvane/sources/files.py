"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_CAP, PIXEL_CAP = 25 << 20, 40_000_000


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under ``schema``; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad lines as file, line_no, raw), line_no counting the lines of the file from 1.

    Large files are read in blocks by many tasks: lines are numbered within a
    block and shifted by the lines of the blocks before, one number a block.
    """
    from pyspark.sql import Window as W

    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_name").alias("file")]
    lines = spark.read.text(path).select(F.col("value").alias("raw"), *meta, F.monotonically_increasing_id().alias("_order"))
    blocks = lines.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_path", "_block").orderBy("_order"))
    lines = lines.withColumn("_k", place).join(blocks.select("_path", "_block", before.alias("_before")), ["_path", "_block"])
    lines = lines.select("file", (F.col("_k") + F.col("_before") - 1).cast("int").alias("line_no"), "raw").filter(F.trim("raw") != "")
    full = schema + ", _corrupt string"
    read = lines.withColumn("r", F.from_json("raw", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    good = read.filter(~bad).select("file", (F.col("line_no") + 1).alias("line_no"), "r.*").drop("_corrupt")
    return good, read.filter(bad).select("file", (F.col("line_no") + 1).alias("line_no"), "raw")


def read_json_map(spark: SparkSession, path: str, field: str, value_schema: str) -> DataFrame:
    """One row for each entry (key, value.*) of the object under ``field`` of whole-file JSON documents."""
    docs = spark.read.schema(f"{field} map<string, struct<{value_schema}>>").option("multiLine", "true").json(path)
    return docs.select(F.explode(field).alias("key", "value")).select("key", "value.*")


def _json_items(data: bytes, field: str | None) -> Iterator[object]:
    """Elements of a JSON array one at a time, so that the parsed form of the whole is never held."""
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8")
    at = text.index("[", text.index(f'"{field}"') if field else 0) + 1
    decoder, blank = json.JSONDecoder(), " \t\r\n"
    while True:
        while at < len(text) and text[at] in blank + ",":
            at += 1
        if at >= len(text):
            raise ValueError("the array is not closed")
        if text[at] == "]":
            return
        item, at = decoder.raw_decode(text, at)
        yield item


def read_json_arrays_of(contents: DataFrame, schema: str, field: str | None = None) -> DataFrame:
    """Elements of the array in each ``content``, plain or gzip, under ``schema``; one that is malformed is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held = []
                for item in _json_items(bytes(content), field):
                    held.append(json.dumps(item))
                    if len(held) == 5000:
                        yield pd.DataFrame({"item": held})
                        held = []
                yield pd.DataFrame({"item": held}, dtype=object)

    items = contents.select("content").mapInPandas(run, "item string")
    return items.select(F.from_json("item", schema).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """``read_json_arrays_of`` the files at ``path``."""
    return read_json_arrays_of(spark.read.format("binaryFile").load(path), schema, field)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under ``schema``: an id of digits stays a string if the schema says so."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def _load_yaml(text: str, mapping: Callable[[list[tuple[object, object]]], dict]) -> object:
    """A YAML document whose mappings are made by ``mapping`` from their pairs, repeats and all."""
    import yaml  # only where a profile is not JSON

    class Loader(yaml.SafeLoader):
        pass

    def pairs(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        loader.flatten_mapping(node)
        return mapping([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value])

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, pairs)
    return yaml.load(text, Loader)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Threshold rules of a YAML (or JSON) profile; a repeated key, in the file or among the rules, is an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    text = spark.read.format("text").option("wholetext", "true").load(path).first()[0]
    try:
        profile = json.loads(text, object_pairs_hook=unique)
    except json.JSONDecodeError:
        profile = _load_yaml(text, unique)
    if not isinstance(profile, dict) or not profile.get("profile_id") or not profile.get("rules"):
        raise ValueError("a profile needs profile_id and rules")
    rows = [(r["provider"], r["class_name"], float(r["score"]), int(r["min_area"]), float(r["max_fraction"])) for r in profile["rules"]]
    if len({r[:2] for r in rows}) < len(rows):
        raise ValueError("two rules for one provider and class")
    return spark.createDataFrame(rows, "provider string, class_name string, score double, min_area int, max_fraction double")


# The messages of faulty label lines, in the order of the checks.
def yolo_line_error(parts: Column, width: Column, height: Column) -> Column:
    """Message for one label line given as its blank-parted values; null for a sound one."""
    word = F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"(?i)\A[+-]?(nan|inf|infinity)\z")) | p.try_cast("double").isNotNull())
    v = F.transform(parts, lambda p: p.try_cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    c, x, y, w, h = (F.get(v, F.lit(k)) for k in range(5))
    return (
        F.when(F.size(parts) != 5, F.concat(F.lit("expected 5 values, found "), F.size(parts).cast("string")))
        .when(~word, "non-numeric value").when(~finite, "non-finite value")
        .when((c < 0) | (c != F.rint(c)), F.concat(F.lit("invalid class id "), c.cast("string")))
        .when(~(x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)), "normalized geometry outside [0, 1]")
        .when((x - w / 2 < 0) | (y - h / 2 < 0) | (x + w / 2 > 1) | (y + h / 2 > 1), "box extends outside image")
        .when((w * width <= 1) | (h * height <= 1), "box is one pixel or thinner")
    )


def parse_yolo_labels(files: DataFrame) -> DataFrame:
    """``files`` (text, width, height, ...) with ``boxes`` and ``errors``: sound lines typed, others as ``line n: message``; blank lines are skipped."""
    lines = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), lambda t, i: F.struct((i + 1).alias("n"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("t"))), lambda s: s["t"] != "")
    parsed = F.transform(lines, lambda s: F.struct(s["n"].alias("n"), F.split(s["t"], " ").alias("p"), yolo_line_error(F.split(s["t"], " "), F.col("width"), F.col("height")).alias("e")))
    num = lambda s, k: F.get(s["p"], F.lit(k)).try_cast("double")
    df = files.withColumn("_lines", parsed)
    boxes = F.transform(F.filter("_lines", lambda s: s["e"].isNull()), lambda s: F.struct(
        num(s, 0).cast("int").alias("class_id"), num(s, 1).alias("center_x"), num(s, 2).alias("center_y"), num(s, 3).alias("width"), num(s, 4).alias("height"),
        (num(s, 3) * F.col("width")).alias("pixel_width"), (num(s, 4) * F.col("height")).alias("pixel_height")))
    errors = F.transform(F.filter("_lines", lambda s: s["e"].isNotNull()), lambda s: F.concat(F.lit("line "), s["n"].cast("string"), F.lit(": "), s["e"]))
    return df.withColumn("boxes", boxes).withColumn("errors", errors).drop("_lines")


def parse_wider(files: DataFrame) -> DataFrame:
    """(image, boxes array<array<double>>) of count-prefixed blocks in ``files`` (text); a zero count may have a placeholder row, invalid or thin boxes are dropped."""

    def blocks(text: str) -> Iterator[tuple[str, list[list[float]]]]:
        rows = iter((text or "").splitlines())
        pending: str | None = None
        while True:
            name = pending if pending is not None else next(rows, None)
            pending = None
            if name is None:
                return
            if not name.strip():
                continue
            count, boxes = int(next(rows)), []
            if count == 0:
                peek = next(rows, None)
                cells = (peek or "").split()
                try:
                    holder = len(cells) >= 4 and not any(float(c) for c in cells)
                except ValueError:
                    holder = False
                pending = None if holder else peek
            for _ in range(count):
                v = [float(c) for c in next(rows).split()]
                if len(v) >= 4 and v[2] > 1 and v[3] > 1 and not (len(v) > 7 and int(v[7])):
                    boxes.append(v[:4])
            yield name.strip(), boxes
            if count == 0 and pending is None and peek is None:
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["text"]:
                yield pd.DataFrame(list(blocks(text)), columns=["image", "boxes"])

    return files.select("text").mapInPandas(run, "image string, boxes array<array<double>>")


def parse_ccpd_name(name: Column, width: Column, height: Column) -> Column:
    """struct<x, y, w, h, polygon> from the four corners in a file name, clipped to the image; null if malformed or one pixel thin."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    corners = F.split(F.get(F.split(stem, "-"), F.lit(3)), "_")
    xy = F.transform(corners, lambda c: F.when(F.size(F.split(c, "&")) == 2, F.transform(F.split(c, "&"), lambda v: v.try_cast("double"))))
    side = lambda k, limit: F.transform(xy, lambda p: F.greatest(F.lit(0.0), F.least(limit.cast("double"), F.get(p, F.lit(k)))))
    xs, ys = side(0, width), side(1, height)
    x, y = F.array_min(xs), F.array_min(ys)
    w, h = F.array_max(xs) - x, F.array_max(ys) - y
    whole = (F.size(corners) == 4) & F.forall(xs, lambda v: v.isNotNull()) & F.forall(ys, lambda v: v.isNotNull())
    polygon = F.flatten(F.zip_with(xs, ys, lambda a, b: F.array(a, b)))
    return F.when(whole & (w > 1) & (h > 1), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), polygon.alias("polygon")))


HIERTEXT = "image_id string, image_width int, image_height int, paragraphs array<struct<lines: array<struct<handwritten: boolean, vertices: array<array<double>>>>>>"


def handwritten_lines(annotations: DataFrame) -> DataFrame:
    """(image_id, instance_id, x, y, w, h, polygon) of handwritten lines with three vertices or more and over a pixel wide and high."""
    lines = annotations.select("image_id", F.posexplode("paragraphs").alias("pi", "p")).select("image_id", "pi", F.posexplode("p.lines").alias("li", "l"))
    lines = lines.filter("l.handwritten and size(l.vertices) >= 3")
    side = lambda k: F.transform("l.vertices", lambda v: F.get(v, F.lit(k)))
    xs, ys = side(0), side(1)
    df = lines.select("image_id", "pi", "li", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), F.flatten("l.vertices").alias("polygon"))
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("image_id").orderBy("pi", "li")) - 1
    return df.filter("w > 1 and h > 1").withColumn("instance_id", number).select("image_id", "instance_id", "x", "y", "w", "h", "polygon")


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(stem, paths, bytes) of the files under ``root`` with one of the suffixes, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root).select("path", "length")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return found.groupBy(stem.alias("stem")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.sum("length").alias("bytes"))


def image_header(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from a PNG, JPEG or WEBP header, turned as its orientation says; nulls where it is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at, turned = 2, False
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
                turned = _orientation(data[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", *((h, w) if turned else (w, h))
            at += 2 + size
    return None, None, None


def _orientation(tiff: bytes) -> int:
    try:
        order = "<" if tiff[:2] == b"II" else ">"
        at = struct.unpack(order + "I", tiff[4:8])[0]
        for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
            if tag == 274:
                return value
    except struct.error:
        pass
    return 1


def probe_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, format, width, height, error): header facts of image files, over-sized ones refused unread."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, n, c in zip(pdf["path"], pdf["length"], pdf["content"]):
                data = bytes(c) if c is not None else b""
                kind, w, h = image_header(data)
                error = "too_many_bytes" if n > BYTE_CAP else "unknown_format" if kind is None else "too_many_pixels" if w * h > PIXEL_CAP else None
                rows.append((p, n, hashlib.sha256(data).hexdigest() if data else None, kind, w, h, error))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256", "format", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= BYTE_CAP, F.col("content")).alias("content"))
    return files.mapInPandas(run, "path string, bytes bigint, sha256 string, format string, width int, height int, error string")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes, safe, copies) of tar archives, plain or gzip; links, devices, absolute names and climbing names are not safe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(bytes(c)), mode="r:*") as tar:
                    rows = [(p, m.name, m.size, (m.isfile() or m.isdir()) and not m.name.startswith("/") and ".." not in m.name.split("/")) for m in tar]
                yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "safe"])

    members = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, bytes bigint, safe boolean")
    return members.groupBy("archive", "member").agg(F.max("bytes").alias("bytes"), F.min("safe").alias("safe"), F.count(F.lit(1)).alias("copies"))


def inventory_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n) of a tab-parted text inventory of name and kind; the header and lines without a tab are skipped."""
    lines = spark.read.text(path).filter(F.col("value").contains("\t") & ~F.lower("value").startswith("name\t"))
    return lines.groupBy(F.trim(F.split_part("value", F.lit("\t"), F.lit(2))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def guard_path(path: str, banned: str = "test") -> str:
    """``path``, unless a part of it holds the banned word."""
    if banned in path.lower():
        raise ValueError(f"{path} holds {banned!r}")
    return path


def write_jsonl(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """JSON lines with fields in sorted order; the committer makes the result appear whole or not at all."""
    out = df.select(*sorted(df.columns))
    (out.orderBy(*sort) if sort else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_split_jsonl(df: DataFrame, path: str, split: str, key: str) -> None:
    """A folder a split, each file sorted by ``key``."""
    df.repartitionByRange(split, key).sortWithinPartitions(split, key).write.mode("overwrite").partitionBy(split).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows to an event log that ``streaming.events.read_events`` follows."""
    df.write.mode("append").json(path)
