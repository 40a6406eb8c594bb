"""File sources and sinks, providers and streams."""

import gzip
import io
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import providers as U
from corvane.sources import files as S
from corvane.streaming import events as E


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image_id":"1","w":2}\n\n{"image_id":"2","w":3}\n')
    assert S.read_jsonl(spark, str(tmp_path), "image_id string, w int").count() == 2
    (tmp_path / "a.jsonl").write_text('{"image_id":"1","w":2}\n\n{"image_id":\n')
    good, bad = S.read_jsonl_with_errors(spark, str(tmp_path), "image_id string, w int")
    assert [tuple(r) for r in good.collect()] == [("a.jsonl", 1, "1", 2)]
    assert [(r["line_no"], r["raw"]) for r in bad.collect()] == [(3, '{"image_id":')]


def test_json_map_and_array(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"annotations": {"a": {"w": 1}, "b": {"w": 2}}}, indent=1))
    assert sorted(tuple(r) for r in S.read_json_map(spark, str(tmp_path / "m.json"), "annotations", "w int").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "z.json.gz").write_bytes(gzip.compress(json.dumps({"annotations": [{"w": 1}, {"w": 2}]}).encode()))
    assert S.read_json_array(spark, str(tmp_path / "z.json.gz"), "w int", "annotations").count() == 2
    (tmp_path / "bad.json").write_text('[{"w": 1}, ')
    with pytest.raises(Exception):
        S.read_json_array(spark, str(tmp_path / "bad.json"), "w int").count()


def test_csv_keeps_ids(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5)], "image_id string, v double")
    S.write_csv(df, str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c"), "image_id string, v double").first()["image_id"] == "007"


def test_rules(spark, tmp_path):
    rule = {"provider": "a", "class_name": "*", "score": 0.5, "min_area": 1, "max_fraction": 0.1}
    (tmp_path / "r.json").write_text(json.dumps({"profile_id": "p", "rules": [rule]}))
    assert S.read_rules(spark, str(tmp_path / "r.json")).count() == 1
    (tmp_path / "r.json").write_text(json.dumps({"profile_id": "p", "rules": [rule, rule]}))
    with pytest.raises(ValueError):
        S.read_rules(spark, str(tmp_path / "r.json"))


def test_yaml_rules_refuse_a_repeated_key(spark, tmp_path):
    text = "profile_id: p\nrules:\n- {provider: a, class_name: '*', score: 0.1, min_area: 1, max_fraction: 0.1}\n"
    (tmp_path / "r.yaml").write_text(text)
    assert S.read_rules(spark, str(tmp_path / "r.yaml")).first()["score"] == 0.1
    (tmp_path / "r.yaml").write_text(text.replace("score: 0.1", "score: 0.1, score: 0.9"))
    with pytest.raises(ValueError):
        S.read_rules(spark, str(tmp_path / "r.yaml"))


def test_yolo_lines(spark):
    text = "0 0.5 0.5 0.4 0.2\n0 0.95 0.5 0.2 0.2\n\n0 1 2\nx 1 1 1 1\n0 nan 0 0 0\n0.5 0.5 0.5 0.1 0.1\n0 2 0.5 0.1 0.1\n0 0.5 0.5 0.001 0.5"
    r = S.parse_yolo_labels(spark.createDataFrame([(text, 100, 80)], "text string, width int, height int")).first()
    assert [(b["pixel_width"], b["pixel_height"]) for b in r["boxes"]] == [(40.0, 16.0)]
    assert r["errors"] == [
        "line 2: box extends outside image", "line 4: expected 5 values, found 3", "line 5: non-numeric value", "line 6: non-finite value",
        "line 7: invalid class id 0.5", "line 8: normalized geometry outside [0, 1]", "line 9: box is one pixel or thinner",
    ]


def test_wider_blocks(spark):
    text = "a/1.jpg\n2\n1 2 30 40 0 0 0 0\n1 2 30 40 0 0 0 1\nb/2.jpg\n0\n0 0 0 0 0 0 0 0\nc/3.jpg\n1\n5 5 1 9\n"
    got = S.parse_wider(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["image"], len(r["boxes"])) for r in got] == [("a/1.jpg", 1), ("b/2.jpg", 0), ("c/3.jpg", 0)]


def test_ccpd_name(spark):
    name = "025-90_0-1&2_3&4-70&60_10&20_10&60_70&20-0_0-1-2.jpg"
    r = spark.range(1).select(S.parse_ccpd_name(F.lit(name), F.lit(720), F.lit(1160)).alias("a"), S.parse_ccpd_name(F.lit("x.jpg"), F.lit(9), F.lit(9)).alias("b")).first()
    assert (r["a"]["x"], r["a"]["y"], r["a"]["w"], r["a"]["h"]) == (10, 20, 60, 40) and r["b"] is None


def test_handwritten_lines(spark):
    ann = [("i", 9, 9, [([(True, [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0]]), (False, [[0.0, 0.0]] * 3), (True, [[1.0, 1.0]])],)])]
    r = S.handwritten_lines(spark.createDataFrame(ann, S.HIERTEXT)).collect()
    assert [(x["instance_id"], x["w"], x["h"]) for x in r] == [(0, 4.0, 3.0)]


def test_images_listing_and_tar(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    (tmp_path / "p.png").write_bytes(png)
    (tmp_path / "q.png").write_bytes(b"none")
    rows = {r["path"].rpartition("/")[2]: r for r in S.probe_images(spark, str(tmp_path / "*.png")).collect()}
    assert (rows["p.png"]["width"], rows["p.png"]["height"]) == (640, 480) and rows["q.png"]["error"] == "unknown_format"
    assert sorted(r["stem"] for r in S.list_files(spark, str(tmp_path), (".png",)).collect()) == ["p", "q"]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name in ("ok/a.txt", "../b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    assert {r["member"]: r["safe"] for r in S.tar_members(spark, str(tmp_path / "t.tar.gz")).collect()} == {"ok/a.txt": True, "../b.txt": False}


def test_inventory_sinks_and_guard(spark, tmp_path):
    (tmp_path / "inv.txt").write_text("Name\tkind\na\tx\nb\tx\nno tab\nc\ty\n")
    assert {r["kind"]: r["n"] for r in S.inventory_counts(spark, str(tmp_path / "inv.txt")).collect()} == {"x": 2, "y": 1}
    df = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "val")], "image_id string, split string")
    S.write_split_jsonl(df, str(tmp_path / "s"), "split", "image_id")
    assert spark.read.schema("image_id string, split string").json(str(tmp_path / "s")).count() == 3
    S.write_jsonl(df, str(tmp_path / "j"), ["image_id"])
    assert spark.read.json(str(tmp_path / "j")).columns == ["image_id", "split"]
    with pytest.raises(ValueError):
        S.guard_path("/data/test2017/x")


def test_event_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    S.append_events(spark.createDataFrame([(1.0, "epoch", {"k": "v"})], E.EVENT_LOG), log)
    S.append_events(spark.createDataFrame([(2.0, "epoch", {"k": "w"})], E.EVENT_LOG), log)
    assert E.run_to_files(E.read_events(spark, log), str(tmp_path / "cp"), "append").select("time_unix").count() == 2


def test_providers(spark):
    class Gone(U.StubProvider):
        def check(self):
            raise U.ProviderUnavailable("no model here")

    images = spark.createDataFrame([(1, 100, 80), (2, 2000, 1500)], "image_id bigint, width int, height int")
    found, status = U.orchestrate(images, [U.StubProvider("a"), Gone("b")])
    assert found.count() == 2 and {r["provider"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "unavailable"}
    tiled = U.run_tiled(images, U.StubProvider(), tile_size=512, overlap=0.0, min_side=1024, max_tiles=50)
    assert tiled.filter("x1 > 2000 or y1 > 1500").count() == 0 and tiled.select("image_id").distinct().count() == 1
    with pytest.raises(ValueError):
        U.orchestrate(images, [U.StubProvider("a"), U.StubProvider("a")])


def test_line_numbers_go_on_across_blocks(spark, tmp_path):
    lines = [json.dumps({"image_id": str(i), "w": i}) if i % 97 else "{bad" for i in range(1, 3001)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("{bad\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        good, bad = S.read_jsonl_with_errors(spark, str(tmp_path), "image_id string, w int")
        assert {(r["file"], r["line_no"]) for r in bad.collect()} == {("a.jsonl", i) for i in range(97, 3001, 97)} | {("b.jsonl", 1)}
        assert all(r["line_no"] == r["w"] for r in good.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
