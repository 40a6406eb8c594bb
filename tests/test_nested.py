"""Problem 6 against a plain walk, and its special cases."""

import json

from corvane.operators import nested as N


# A plain walk over parsed documents, one at a time.
def _number(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _whole(x):
    n = _number(x)
    return int(n) if n is not None and n == n and abs(n) < 2**31 and n == int(n) else None


def _is_point(x):
    return (isinstance(x, list) and len(x) == 2 and all(_number(v) is not None for v in x)) or (isinstance(x, dict) and "x" in x and "y" in x)


def _coordinates(x):
    """One polygon as a flat list: numbers, [x, y] pairs, {x, y} objects, or an object with points."""
    if isinstance(x, dict):
        return _coordinates(x["points"]) if "points" in x else [_number(x["x"]), _number(x["y"])] if _is_point(x) else None
    if not isinstance(x, list):
        return None
    flat = []
    for v in x:
        if isinstance(v, (list, dict)):
            flat += _coordinates(v) or []
        else:
            flat.append(_number(v))
    return flat


def _members(x):
    return list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []


def _polygons(x):
    """A list of polygons from any of the shapes delivered; null and empty entries keep their place."""
    if isinstance(x, dict):
        return [_coordinates(x)] if "points" in x else [_coordinates(v) for v in x.values()]
    if not isinstance(x, list):
        return None
    there = [v for v in x if v is not None]
    bare = bool(there) and (all(_number(v) is not None for v in there) or all(_is_point(v) for v in there))
    return [_coordinates(x)] if bare else [_coordinates(v) for v in x]


def _bbox(x):
    if isinstance(x, dict):
        return [_number(x.get(k)) for k in ("x", "y", "w", "h")]
    return [_number(v) for v in x] if isinstance(x, list) else None


def _instance(x):
    if not isinstance(x, dict):
        return None
    name = x.get("attr_id")
    return {"class_id": _whole(x.get("class_id")), "attr_id": name if isinstance(name, str) else None, "bbox": _bbox(x.get("bbox")), "polygons": _polygons(x.get("polygons"))}


def _of_payload(text):
    """The record in one JSON document, whichever envelope it came in; no instances where it is not one."""
    try:
        doc = json.loads(text) if text else None
    except (ValueError, RecursionError):
        doc = None
    doc = doc if isinstance(doc, dict) else {}
    body = doc.get("record") if isinstance(doc.get("record"), dict) else doc
    image = body.get("image") if isinstance(body.get("image"), dict) else body
    size = image.get("size", body.get("size"))
    if isinstance(size, dict):
        size = [size.get("width"), size.get("height")]
    elif not isinstance(size, list):
        size = [image.get("width"), image.get("height")]
    found = None
    layers = body.get("annotations")
    for holder in [body, *(layers if isinstance(layers, list) else [layers])]:
        if isinstance(holder, dict) and isinstance(holder.get("instances"), (list, dict)):
            found = (found or []) + [_instance(v) for v in _members(holder["instances"])]
    image_id, negative = image.get("image_id"), doc.get("negative_for_profile", body.get("negative_for_profile"))
    size = [*size, None, None]
    return {"image_id": image_id if isinstance(image_id, str) else None, "width": _whole(size[0]), "height": _whole(size[1]), "negative": negative if isinstance(negative, bool) else None, "instances": found}


def places(rows):
    out = set()
    for rid, inst in rows:
        there = 0
        for k, i in enumerate(inst or []):
            if i is None:
                continue
            there += 1
            ps = [j for j, p in enumerate(i["polygons"] or []) if p and any(v is not None for v in p)]
            out |= {(rid, k, j) for j in ps or [-1]}
        if not there:
            out.add((rid, -1, -1))
    return out


def test_processed_records(spark, data):
    p = spark.read.parquet(f"{data}/processed_records.parquet")
    got = [tuple(r) for r in N.flatten(N.processed_as_records(p), "places").collect()]
    assert len(got) == len(set(got)) and set(got) == places([(r["row_id"], r["instances"]) for r in p.collect()])


DOCS = [
    {"image_id": "a", "width": 4, "height": 3, "instances": [None, {"polygons": [[1, 2, 3, 4, 5, 6], None, []]}, {"polygons": [1, 2, 3, 4, 5, 6]}]},
    {"record": {"image": {"image_id": "b", "size": [4, 3]}, "annotations": {"instances": {"i9": {"polygons": [[[1, 2], [3, 4], [5, 6]]]}, "i1": None, "i2": {"bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}}}}},
    {"image_id": "c", "annotations": [{"layer": "p", "instances": [{"polygons": [{"points": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}]}]}, {"layer": "q", "instances": [{"polygons": None}]}], "size": {"width": 4, "height": 3}},
    {"image_id": "d", "instances": []},
    {"image_id": "e", "instances": [{"polygons": [[1, 2], [3, 4], [5, 6]], "class_id": "x", "bbox": [1]}]},
]
EXPECTED = {(0, 1, 0), (0, 2, 0), (1, 0, 0), (1, 2, -1), (2, 0, 0), (2, 1, -1), (3, -1, -1), (4, 0, 0), (5, -1, -1), (6, -1, -1), (7, -1, -1)}


def payloads(spark):
    texts = [json.dumps(x) for x in DOCS] + [None, "", "{broken"]
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "payload_id bigint, payload string, row_id string")


def test_payload_shapes(spark):
    r = N.payloads_as_records(payloads(spark))
    assert {tuple(x) for x in N.flatten(r, "places").collect()} == EXPECTED
    flat = {x["row_id"]: x for x in N.flat_records(r).collect()}
    assert [(flat[i]["image_id"], flat[i]["width"], flat[i]["n_instances"]) for i in range(4)] == [("a", 4, 2), ("b", 4, 2), ("c", 4, 2), ("d", None, 0)]


ODD = [
    '{"instances": [{"polygons": {"b": [1, 2, 3], "a": {"points": [{"y": 2, "x": 1}, [3, 4], null]}, "c": null}}, {"polygons": {"points": [1, 2]}}, {"polygons": {"x": 1, "y": 2}}]}',
    '{"instances": [{"polygons": [[1, 2], null, {"x": 3, "y": 4}]}, {"polygons": [[1, 2], [3, 4, 5]]}, {"polygons": [[[[1, 2]], [3]], {"z": 1}, 7, "s"]}, {"polygons": [null]}, 5, [1]]}',
    '{"x,]}\\\\": "a\\"[{", "record": {"image": {"image_id": "q\\"r", "size": [3.0, "4"]}, "annotations": {"instances": [{"attr_id": "a,b}", "class_id": 2.5, "bbox": {"x": 1, "h": 2}}]}}, "negative_for_profile": true}',
    '{"instances": {}, "annotations": [{"instances": [{"polygons": [1, 2]}]}, 3, null, {"instances": {"k": {"polygons": []}}}], "width": 1e1, "height": 2147483648}',
    '{"record": null, "image": {"image_id": 5}, "size": {"width": 3}, "instances": [{"bbox": [1, null, "x", 4, 5]}, {"bbox": 3}, {}], "negative_for_profile": "x"}',
    "[]", "7", '"text"', "null", '{"a": 1', '{"a": "x}', "} {", '  {"instances" : [ { "polygons" : [ [ 1 , 2 ] , [ ] ] } ] }  ',
]


def test_scan_equals_a_walk(spark, data):
    texts = [r["payload"] for r in spark.read.parquet(f"{data}/record_payloads.parquet").collect()] + ODD + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "payload_id bigint, payload string")
    got = {r["row_id"]: r for r in N.payloads_as_records(df).collect()}
    plain = lambda x: None if x is None else [None if v is None else v for v in x]
    for i, text in enumerate(texts):
        want, r = _of_payload(text), got[i]
        assert (r["width"], r["height"], r["negative_for_profile"]) == (want["width"], want["height"], want["negative"]), text
        assert r["image_id"] == want["image_id"] or "\\" in (r["image_id"] or ""), text
        mine, theirs = r["instances"] or [], want["instances"] or []
        assert [v is None for v in mine] == [v is None for v in theirs], text
        for a, b in zip(mine, theirs):
            if a is not None:
                assert (a["class_id"], a["attr_id"]) == (b["class_id"], b["attr_id"]) and (plain(a["bbox"]) or []) == (b["bbox"] or []), text
                assert [p or [] for p in a["polygons"] or []] == [p or [] for p in b["polygons"] or []], text


def test_all_tables_scan_once(spark, data):
    p, q = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("processed_records", "record_payloads"))
    tables = N.all_tables(p, q)
    for which in ("records", "polygons", "places"):
        assert sorted(map(str, tables[which].collect())) == sorted(map(str, N.both_sources(p, q, which).collect()))


def test_children_name_their_parents(spark):
    r = N.payloads_as_records(payloads(spark))
    pts = {(x["row_id"], x["instance_no"], x["polygon_no"], x["point_no"]): (x["x"], x["y"]) for x in N.flatten(r, "points").collect()}
    assert pts[0, 1, 0, 2] == (5, 6) and pts[1, 0, 0, 1] == (3, 4) and pts[2, 0, 0, 1] == (3, 4) and pts[4, 0, 0, 2] == (5, 6)
    inst = {(x["row_id"], x["instance_no"]): x for x in N.flatten(r, "instances").collect()}
    assert inst[1, 2]["bbox_h"] == 4 and inst[4, 0]["class_id"] is None and inst[4, 0]["bbox_x"] == 1 and inst[4, 0]["bbox_y"] is None
    poly = N.flatten(r, "polygons").collect()
    assert sorted((x["row_id"], x["n_points"]) for x in poly) == [(0, 3), (0, 3), (1, 3), (2, 2), (4, 3)]


def test_odd_coordinate_and_empty_table(spark):
    df = spark.createDataFrame([(1, [(1, "a", None, [[1.0, 2.0, 3.0], [None]])]), (2, None)], f"row_id bigint, instances array<{N.INSTANCE}>")
    assert {tuple(r) for r in N.flatten(df, "places").collect()} == {(1, 0, 0), (2, -1, -1)}
    assert [(r["x"], r["y"]) for r in N.flatten(df, "points").orderBy("point_no").collect()] == [(1.0, 2.0), (3.0, None)]
    for which in ("places", "instances", "polygons", "points"):
        assert N.flatten(df.limit(0), which).count() == 0
