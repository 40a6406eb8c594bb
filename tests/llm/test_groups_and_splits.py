"""Problems 1 and 3 against union-find, and their special cases."""

import re
from collections import defaultdict

import pytest

from corvane.llm import groups as G
from corvane.llm import splits as S
from corvane.llm.groups import reduced_components


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


AUDIT = "record_id bigint, dataset_id string, group_id string, source_video_group string, source_split string, phash bigint, boxes array<struct<class_id:int,center_x:double,center_y:double,width:double,height:double>>, root string, component string"


def audit(spark, rows):
    """rows: (record_id, dataset, group, video, split, phash)"""
    return spark.createDataFrame([(*r, [(0, 0.5, 0.5, 0.1, 0.1)], "clash", "clash") for r in rows], AUDIT)


MATCH = "match_id bigint, left_record_id bigint, right_record_id bigint, match_kind string, phash_distance int"


def test_p3_on_the_tables(spark, data):
    a, m = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("audit_yolo_detection_dataset", "phash_matches"))
    got = {(r["group_root"], r["record_id"]) for r in G.consolidate_matches(a, m).filter("group_size > 1").collect()}
    u, rows = Union(), {r["record_id"]: r for r in a.collect()}
    by = defaultdict(list)
    for i, r in rows.items():
        u.find(i)
        if r["group_id"] is not None:
            by[r["dataset_id"], r["group_id"]].append(i)
    for ids in by.values():
        for i in ids:
            u.join(ids[0], i)
    for r in m.collect():
        x, y = r["left_record_id"], r["right_record_id"]
        if x not in rows or y not in rows or x == y:
            continue
        d = r["phash_distance"]
        if d is None and rows[x]["phash"] is not None and rows[y]["phash"] is not None:
            d = bin((rows[x]["phash"] ^ rows[y]["phash"]) & (2**64 - 1)).count("1")
        if r["match_kind"] == "sha256" or (r["match_kind"] == "phash" and d is not None and d <= 2):
            u.join(x, y)
    sizes = defaultdict(int)
    for i in rows:
        sizes[u.find(i)] += 1
    assert got == {(u.find(i), i) for i in rows if sizes[u.find(i)] > 1}


def test_p3_special_cases(spark):
    a = audit(spark, [(1, "d", "g", None, "train", 0), (2, "d", "g", None, "train", None), (3, "e", "g", None, "val", 3), (3, "e", "g", None, "val", 3), (4, None, "g", None, None, -1), (None, "d", "g", None, "train", 1), (5, "d", None, None, "train", -2)])
    m = spark.createDataFrame([(1, 3, 1, "phash", None), (2, 1, 1, "sha256", None), (3, None, 1, "sha256", None), (4, 99, 1, "sha256", None), (5, 2, 4, "phash", None), (6, 4, 5, "phash", 3), (7, 5, 4, "phash", None), (8, 4, 5, "other", 0), (7, 5, 4, "phash", None)], MATCH)
    got = sorted(map(tuple, G.consolidate_matches(a, m).collect()))
    assert got == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (4, 4, 2), (4, 5, 2)]
    assert G.consolidate_matches(a.limit(0), m).count() == 0
    assert sorted(map(tuple, G.consolidate_matches(a, m.limit(0)).collect())) == [(1, 1, 2), (1, 2, 2), (3, 3, 1), (4, 4, 1), (5, 5, 1)]


def check_components(spark, edges):
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    got = {r["vertex"]: r["root"] for r in G.reduced_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == set(u.p)
    same = defaultdict(set)
    for v, r in got.items():
        same[r].add(u.find(v))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({u.find(v) for v in got})


def test_reduction_on_paths_cycles_stars_and_cores(spark):
    path = [(i, i + 1) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    star = [(2000, 2001 + i) for i in range(80)]
    core = [(3000 + i, 3000 + j) for i in range(7) for j in range(i)] + [(3006, 4000), (4000, 4001)]
    tree = [(5000 + i, 5000 + (i - 1) // 2) for i in range(1, 64)]
    noise = [(1, 1), (None, 5), (6, None), (2, 1), (1, 2)]
    check_components(spark, path + ring + star + core + tree + noise)
    check_components(spark, [(1, 2)])
    check_components(spark, core[:21])


def norm(v):
    v = re.sub("[^a-z0-9]+", "-", (v or "").lower()).strip("-")
    return None if v in ("", "unknown", "none", "n-a") else v


def test_p1_on_the_tables(spark, data):
    a, t = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("audit_yolo_detection_dataset", "split_targets"))
    out = S.group_safe_splits(a, t).collect()
    rows, u = {r["record_id"]: r for r in a.collect()}, Union()
    for i, r in rows.items():
        u.find(("r", i))
        for key in (("v", norm(r["source_video_group"])), ("g", (r["dataset_id"], r["group_id"]))):
            if key[1] is not None and (key[0] == "v" or r["group_id"] is not None):
                u.join(("r", i), (key[0], str(key[1])))
    splits = defaultdict(set)
    for i, r in rows.items():
        splits[u.find(("r", i))].add({"valid": "val"}.get(r["source_split"], r["source_split"]))
    assert {r["record_id"] for r in out if r["crosses"]} == {i for i in rows if len(splits[u.find(("r", i))]) > 1}
    assert len(out) == len(rows)
    for p in {r["plan_id"] for r in t.collect()}:
        given = {r["record_id"]: dict(r["splits"])[p] for r in out}
        whole = defaultdict(set)
        for i in rows:
            whole[u.find(("r", i))].add(given[i])
        assert all(len(x) == 1 for x in whole.values())
        for x in t.filter(f"plan_id = {p}").collect():
            share = sum(s == x["split"] for s in given.values()) / len(given)
            assert abs(share - x["target_permille"] / 1000) < 0.02


def test_p1_special_cases(spark):
    a = audit(spark, [(1, "d", "g", " Road_Cam--1 ", "train", 0), (2, "d", None, "road-cam-1", "valid", 0), (3, "d", "g", None, "val", 0), (4, "e", "g", "N/A", "train", 0), (5, None, "g", "unknown", None, 0), (5, None, "g", "unknown", None, 0), (None, "d", "g", None, "test", 0), (6, "e", None, "", "val", 0)])
    t = spark.createDataFrame([(1, "train", 700), (1, "val", 300), (2, "all", 1000), (3, None, 5), (4, "x", 0)], "plan_id int, split string, target_permille int")
    out = {r["record_id"]: r for r in S.group_safe_splits(a, t).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6]
    assert {i for i, r in out.items() if r["crosses"]} == {1, 2, 3}
    assert len({out[i]["component"] for i in (1, 2, 3)}) == 1 and len({r["component"] for r in out.values()}) == 4
    assert all([p for p, _ in r["splits"]] == [1, 2] for r in out.values()) and len({tuple(map(tuple, out[i]["splits"])) for i in (1, 2, 3)}) == 1
    assert S.group_safe_splits(a.limit(0), t).count() == 0
    assert all(r["splits"] == [] for r in S.group_safe_splits(a, t.limit(0)).collect())


def test_large_components_are_balanced(spark):
    rows = [(i, "d", f"g{0 if i < 700 else 1 if i < 1100 else i}", None, "train", 0) for i in range(2000)]
    t = spark.createDataFrame([(1, "train", 600), (1, "val", 400)], "plan_id int, split string, target_permille int")
    report = {r["split"]: r["share_permille"] for r in S.split_report(S.group_safe_splits(audit(spark, rows), t), audit(spark, rows), t).collect()}
    assert abs(report["train"] - 600) < 10 and abs(report["val"] - 400) < 10


def test_reduction_to_the_bare_core_gives_the_same(spark):
    """Stripped until nothing is left to strip, or until it hardly pays: the same components; rounds beyond the bound are an error."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (102, 40), (200, 201), (300, 300), (7, 500)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    parts = []
    for step in (0.0, 0.1):
        by = {}
        for r in reduced_components(df, small_step=step).collect():
            by.setdefault(r["root"], set()).add(r["vertex"])
        parts.append(sorted(map(sorted, by.values())))
    assert parts[0] == parts[1] == sorted([sorted({*range(41), 100, 101, 102, 500}), [200, 201]])
    with pytest.raises(RuntimeError):
        reduced_components(df, max_rounds=1, small_step=0.0)


def test_labels_are_balanced_each_by_itself(spark, monkeypatch):
    """Twenty classes of very different size: the search lowers the deviation of a hashed start, in size and in labels, over several blocks."""
    import random

    monkeypatch.setattr(S, "BLOCK", 200)
    rng = random.Random(8)
    rows = [(i, "d", f"g{i // 3}", None, "train", 0, [(min(int(rng.expovariate(0.3)), 19), 0.5, 0.5, 0.1, 0.1) for _ in range(i % 4)]) for i in range(3000)]
    a = spark.createDataFrame(rows, "record_id bigint, dataset_id string, group_id string, source_video_group string, source_split string, phash bigint, boxes array<struct<class_id:int,center_x:double,center_y:double,width:double,height:double>>")
    t = spark.createDataFrame([(1, "train", 700), (1, "val", 200), (1, "test", 100)], "plan_id int, split string, target_permille int")
    reports = {}
    for steps in (0, 1):
        if not steps:
            keep = S._anneal
            monkeypatch.setattr(S, "_anneal", lambda sizes, aims, start, seed, steps: (0.0, start))
        else:
            monkeypatch.setattr(S, "_anneal", keep)
        reports[steps] = S.split_report(S.group_safe_splits(a, t), a, t).collect()
    off = {k: sum(abs(r["share_permille"] - r["target_permille"]) for r in rs) for k, rs in reports.items()}
    labels = {k: max(r["label_deviation_permille"] for r in rs) for k, rs in reports.items()}
    assert off[1] < 4 and off[1] < off[0] and labels[1] < 0.5 * labels[0]


def test_more_labels_than_bounded_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_LABELS", 2)
    a = spark.createDataFrame([(i, "d", None, None, "train", 0, [(i, 0.5, 0.5, 0.1, 0.1)]) for i in range(3)], "record_id bigint, dataset_id string, group_id string, source_video_group string, source_split string, phash bigint, boxes array<struct<class_id:int,center_x:double,center_y:double,width:double,height:double>>")
    with pytest.raises(ValueError):
        S.group_safe_splits(a, spark.createDataFrame([(1, "x", 1)], "plan_id int, split string, target_permille int"))
