"""Problem 5 against a plain reader, and its special cases."""

import datetime
import math
import re

from corvane.sources.label_export import REASONS, loaded, read_label_export, rejected


def cells(t):
    out, i = [], 0
    while True:
        if t[i : i + 1] == '"':
            j, buf = i + 1, []
            while True:
                k = t.find('"', j)
                if k < 0:
                    return None
                buf.append(t[j:k])
                if t[k + 1 : k + 2] != '"':
                    break
                buf.append('"')
                j = k + 2
            i = k + 1
            if i < len(t) and t[i] != ",":
                return None
            out.append("".join(buf))
        else:
            k = t.find(",", i)
            k = len(t) if k < 0 else k
            if '"' in t[i:k]:
                return None
            out.append(t[i:k])
            i = k
        if i >= len(t):
            return out
        i += 1


def reason(raw):
    t = raw[:-1] if raw.endswith("\r") else raw
    cs = cells(t)
    if cs is None:
        return REASONS[0]
    if len(cs) != 8:
        return REASONS[1]
    if any(not re.fullmatch("[0-9]+", x) or int(x) == 0 for x in cs[1:3]):
        return REASONS[2]
    try:
        assert re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", cs[6])
        datetime.datetime.strptime(cs[6], "%Y-%m-%dT%H:%M:%SZ")
    except (AssertionError, ValueError):
        return REASONS[3]
    faults = set()
    for b in cs[3].split(";") if cs[3].strip() else []:
        v = [x for x in re.split(r"[ \t]+", b) if x]
        if len(v) != 5:
            faults.add(4)
            continue
        try:
            n = [float(x.replace("_", "?")) for x in v]
        except ValueError:
            faults.add(5)
            continue
        if not all(map(math.isfinite, n)):
            faults.add(6)
            continue
        k, x, y, w, h = n
        faults |= {7} if k < 0 or k != int(k) else set()
        faults |= set() if 0 <= x <= 1 and 0 <= y <= 1 and 0 < w <= 1 and 0 < h <= 1 else {8}
        faults |= {9} if x - w / 2 < 0 or x + w / 2 > 1 or y - h / 2 < 0 or y + h / 2 > 1 else set()
        faults |= {10} if w * int(cs[1]) <= 1 or h * int(cs[2]) <= 1 else set()
    return REASONS[min(faults)] if faults else None


GOOD = 'a.txt,640,480,0 0.5 0.5 0.1 0.1,,ann,2025-01-31T23:59:59Z,"x, ""y""\nz"'
CASES = [
    GOOD, GOOD + "\r", GOOD + "\r\r", "", '"', '"a"b,1,1,,,,,', 'a"b,1,1,,,,,', "a,1,1,,,,2025-01-01T00:00:00Z", "a,1,1,,,,2025-01-01T00:00:00Z,,",
    "a,+1,1,,,,2025-01-01T00:00:00Z,", "a,0,1,,,,2025-01-01T00:00:00Z,", "a,99999999999999999999,1,,,,2025-01-01T00:00:00Z,", "a,1,1,,,,2025-02-29T00:00:00Z,",
    "a,1,1,,,,2025-01-01T24:00:00Z,", "a,1,1,,,,2025-01-01 00:00:00Z,", "a,9,9, \t ,,,2025-01-01T00:00:00Z,", "a,9,9,0 .5 .5 .5 .5;,,,2025-01-01T00:00:00Z,",
    "a,9,9,0 .5 .5 .5 .5 ; 1e0 5e-1 +.5 .5 .5,,,2025-01-01T00:00:00Z,", "a,9,9,0 .5 .5 .5 1_0,,,2025-01-01T00:00:00Z,", "a,9,9,0 .5 .5 .5 1e999,,,2025-01-01T00:00:00Z,",
    "a,9,9,0 .5 .5 .5 -Infinity,,,2025-01-01T00:00:00Z,", "a,9,9,-1 .5 .5 .5 .5,,,2025-01-01T00:00:00Z,", "a,9,9,0.5 .5 .5 .5 .5,,,2025-01-01T00:00:00Z,",
    "a,9,9,0 1.5 .5 .5 .5,,,2025-01-01T00:00:00Z,", "a,9,9,0 .9 .5 .5 .5,,,2025-01-01T00:00:00Z,", "a,9,9,0 .5 .5 .1 .5,,,2025-01-01T00:00:00Z,",
    "a,9,9,0 .5 .5 0x1 .5,,,2025-01-01T00:00:00Z,", "a,9,9,0 .5 .5 .5 .5d,,,2025-01-01T00:00:00Z,", '"' + "x" * 200_000 + '",9,9,,,,2025-01-01T00:00:00Z,', '"a""' + '""' * 50_000 + '",9,9,,,,2025-01-01T00:00:00Z,',
]


def frame(spark, raws):
    rows = [(i, "f.csv", i, r, "clash") for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, "raw_id bigint, source_file string, line_no int, raw string, reason string")


def test_cases(spark):
    got = {r["raw_id"]: r["reason"] for r in read_label_export(frame(spark, CASES)).select("raw_id", "reason").collect()}
    assert {i: reason(r) for i, r in enumerate(CASES)} == got


def test_valid_rows_are_typed(spark):
    r = loaded(read_label_export(frame(spark, [GOOD]))).first()
    assert (r["width"], r["height"], r["note"]) == (640, 480, 'x, "y"\nz') and tuple(r["boxes"][0]) == (0, 0.5, 0.5, 0.1, 0.1)


def test_a_valid_row_loses_no_value(spark):
    big = "9" * 20
    raws = [f"a,{big},9,,,,2025-01-01T00:00:00Z,", "a,9,9,1e30 .5 .5 .5 .5;3.0 .5 .5 .5 .5;9007199254740993 .5 .5 .5 .5,,,2025-01-01T00:00:00Z,"]
    one, two = loaded(read_label_export(frame(spark, raws))).orderBy("raw_id").collect()
    assert (one["width"], one["width_text"], one["height"], one["height_text"], one["boxes"]) == (None, big, 9, None, [])
    assert [b["class_id"] for b in two["boxes"]] == [None, 3, 2**53 + 1] and two["class_texts"] == ["1e30", None, None]


def test_null_and_empty(spark):
    assert read_label_export(frame(spark, [None])).first()["reason"] == "column_count"
    assert read_label_export(frame(spark, [GOOD]).limit(0)).count() == 0


def test_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/yolo_label_export.parquet")
    got = {(r["raw_id"], r["reason"]) for r in rejected(read_label_export(rows)).collect()}
    assert got == {(r["raw_id"], w) for r in rows.collect() if (w := reason(r["raw"]))}
