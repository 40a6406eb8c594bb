"""Problems 4 and 7 against brute force, and their special cases."""

import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from corvane.llm import leaks as L
from corvane.llm import overlaps as O

SCAN = "images struct<image_id:string,split:string>, source string, sha256 string, phash bigint, scanned_at timestamp, split string, term bigint, i int"


def brute(rows, d=5):
    last = {}
    for r in rows:
        k = r["images"]["image_id"] if r["images"] else None
        if k is not None and (k not in last or (r["scanned_at"] is not None and (last[k]["scanned_at"] is None or r["scanned_at"] > last[k]["scanned_at"]))):
            last[k] = r
    def side(r):
        return (r["images"]["split"] or "").strip().lower()
    def sha(r):
        m = re.fullmatch("(?:sha256:)?([0-9a-f]{64})", (r["sha256"] or "").strip().lower())
        return m and m.group(1)
    out = set()
    for a, x in last.items():
        for b, y in last.items():
            if side(x) == "train2017" and side(y) in ("val2017", "test2017"):
                near = x["phash"] is not None and y["phash"] is not None and bin((x["phash"] ^ y["phash"]) & (2**64 - 1)).count("1") <= d
                if near or (sha(x) and sha(x) == sha(y)):
                    out.add((a, b))
    return out


def test_p4_on_the_tables(spark, data):
    s = spark.read.parquet(f"{data}/same_release_split_leakage_audit.parquet")
    got = [(r["train_image_id"], r["image_id"]) for r in O.cross_split_overlaps(s).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(s.collect())


def test_p4_every_distance_and_special_cases(spark):
    import datetime as dt

    rng = random.Random(4)
    rows, t = [], dt.datetime(2025, 1, 1)
    for k in range(120):
        h = rng.getrandbits(64)
        g = h
        for b in rng.sample(range(64), k % 9):
            g ^= 1 << b
        sign = lambda v: v - (1 << 64) if v >> 63 else v
        rows.append(((f"t{k}", rng.choice(["train2017", " Train2017"])), "s", None, sign(h), t, "clash", 1, 1))
        rows.append(((f"e{k}", rng.choice(["VAL2017 ", "test2017"])), None if k % 5 == 0 else "s", None, sign(g), t, "clash", 1, 1))
    sha = "ab" * 32
    rows += [
        (("x", "train2017"), "s", "SHA256:" + sha.upper(), None, t, "c", 1, 1), (("y", "val2017"), "s", " " + sha, None, t, "c", 1, 1), (("y", "val2017"), "s", " " + sha, None, t, "c", 1, 1),
        (("z", "val2017"), "s", "nothex", 7, t, "c", 1, 1), (("w", None), "s", sha, 7, t, "c", 1, 1), ((None, "val2017"), "s", sha, 7, t, "c", 1, 1), (None, "s", sha, 7, None, "c", 1, 1),
        (("v", "val2017"), "s", sha, 7, t, "c", 1, 1), (("v", "train2017"), "s", sha, 7, t + dt.timedelta(1), "c", 1, 1),
    ]
    s = spark.createDataFrame(rows, SCAN)
    got = {(r["train_image_id"], r["image_id"]) for r in O.cross_split_overlaps(s).collect()}
    assert got == brute(s.collect()) and ("x", "y") in got and ("v", "y") in got
    report = O.overlap_report(O.cross_split_overlaps(s))
    assert report.groupBy().sum("pairs").first()[0] == len(got) and report.filter("source is null").count() > 0
    assert O.cross_split_overlaps(s.limit(0)).count() == 0


DOC = "doc_id bigint, text string, item_id int, run int"
ITEM = "item_id bigint, suite string, lang string, text string"


def keep(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if unicodedata.category(c)[0] in "LMN")


def brute_leaks(docs, items):
    out = set()
    for i, _, lang, text in items:
        n, k = (25 if lang in ("zh", "ja") else 60), keep(text or "")
        grams = {k[a : a + n] for a in range(len(k) - n + 1)}
        for d, t, *_ in docs:
            x = keep(t or "")
            if any(x[a : a + n] in grams for a in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items):
    return {(r["doc_id"], r["item_id"]) for r in L.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}


def test_p7_on_the_tables(spark, data):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_passages.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, i).collect()}
    assert got == brute_leaks([(r["doc_id"], r["text"]) for r in d.collect()], [tuple(r) for r in i.select("item_id", "suite", "lang", "text").collect()])


def test_p7_run_lengths_at_every_offset(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item, wide = "".join(rng.choices(letters, k=200)), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90))
    noise = lambda n: "".join(rng.choices(letters, k=n))
    docs = []
    for k, n in enumerate([58, 59, 60, 61] * 12):
        a = rng.randrange(0, 200 - n)
        docs.append((k, noise(30) + "9" + " ,­".join(item[a : a + n].upper()) + "9" + noise(30), 0, 0))
    for k, n in enumerate([23, 24, 25, 26] * 8):
        a = rng.randrange(0, 90 - n)
        docs.append((100 + k, noise(5) + wide[a : a + n] + "。" + noise(5), 0, 0))
    items = [(1, "s", "en", item), (2, "s", "ja", wide), (3, "s", None, item[:59]), (4, "s", "en", None), (5, "s", "en", "")]
    assert found(spark, docs, items) == brute_leaks(docs, items)


def test_p7_special_cases(spark):
    item = "".join(chr(97 + k * k % 26) + str(k) for k in range(60))
    long = "x" * 1_200_000 + item + "y" * 600_000
    docs = [(1, None, 0, 0), (2, "", 0, 0), (3, long, 0, 0), (4, "Ａ" * 3 + item, 0, 0), (4, item, 0, 0), (5, item[:40], 0, 0), (6, item[40:], 0, 0)]
    items = [(1, "s", "en", item), (1, "s", "en", item)]
    assert found(spark, docs, items) == {(3, 1), (4, 1), (6, 1)} | ({(5, 1)} if len(keep(item[:40])) >= 60 else set())
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()
    report = L.leak_report(spark.createDataFrame([(1, 1, 70)], "doc_id bigint, item_id bigint, run int"), spark.createDataFrame([(1, "s", "en", "x"), (2, "s", "en", "x")], ITEM))
    assert sorted((r["item_id"], r["documents"]) for r in report.collect()) == [(1, 1), (2, 0)]


def test_p4_bounds_drop_candidates_and_no_pair(spark):
    """Residual norms drop candidates before their dot product is formed; none of those that reach the bound."""
    h = spark.range(3000).select(F.xxhash64("id").alias("g"))
    other = h.limit(400).select(F.col("g").bitwiseXOR(F.lit(0b1000010001)).alias("h")).unionByName(spark.range(3000).select(F.xxhash64(F.lit("x"), "id").alias("h")))
    plan = O.block_plan(64, 5)
    met = O.candidates(h, other, plan).withColumn("kept", O.reachable(5)).withColumn("near", O.dot_product(F.col("g"), F.col("h")) >= O.least(5)).cache()
    assert met.filter("near").count() == met.filter("near and kept").count() == 400
    assert met.filter("not kept").count() > 0.3 * met.count()
    assert O.DIGEST - O.BITS >= O.least(0) and len(plan.masks) - plan.equal == 5


def test_p4_counts_equal_the_listed_pairs(spark, data):
    s = spark.read.parquet(f"{data}/same_release_split_leakage_audit.parquet")
    listed, counted = O.overlap_report(O.cross_split_overlaps(s)), O.overlap_counts(s)
    assert sorted(map(str, listed.collect())) == sorted(map(str, counted.collect())) and listed.count()
    assert O.overlap_counts(s.limit(0)).count() == 0


def test_p7_repeated_text_takes_linear_time():
    """Alike windows of a document are looked at once: a text of equal letters costs what any other does."""
    import time

    import numpy as np

    (blocks,) = L._item_blocks(iter([pd.DataFrame({"item_id": [1], "wide": [False], "text": ["a" * 5000]})]))
    assert len(blocks) < 10
    bits = 1 << 15
    packed = {}
    for column in ("first", "band"):
        on = np.zeros(bits, np.uint8)
        on[L.filter_bits(blocks[column].to_numpy(np.int64).view(np.uint64), bits)] = 1
        packed[column] = {1: np.packbits(on, bitorder="little")}
    sieve, took = L.Sieve(packed["first"], packed["band"], bits), []
    for n in (200_000, 800_000):
        start = time.time()
        passed = sum(len(b) for _, _, b, _ in sieve.windows([L.kept_text("a" * n)]))
        took.append(time.time() - start)
        assert passed < 200 + n / 20
    assert took[1] < 12 * took[0]


def test_p7_short_items_have_longer_blocks():
    """Of an item of any size every run of the length asked for holds a whole block of its partition."""
    rng = random.Random(3)
    for wide, run in ((False, 60), (True, 25)):
        for n in (run, run * 5 // 4, run * 5 // 4 + 1, run * 3):
            text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
            (rows,) = L._item_blocks(iter([pd.DataFrame({"item_id": [1], "wide": [wide], "text": [text]})]))
            p = L.PARTS[rows["part"][0]]
            blocks = [a[p.run : p.run + p.block] for a in rows["around"]]
            assert all(any(b in text[a : a + run] for b in blocks) for a in range(n - run + 1)) and p.block >= run // 2


def test_p7_many_items_read_the_corpus_once(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    items = [(i, "s", "en", text(rng.randrange(60, 140))) for i in range(3000)]
    docs = [(k, text(50) + items[k * 7][3][-60:] + text(50), 0, 0) for k in range(300)] + [(900, text(4000), 0, 0)]
    assert found(spark, docs, items) == {(k, k * 7) for k in range(300)}


def test_p7_filters_that_pass_all_lose_and_break_nothing():
    """A full filter lets every window through, the last ones of a text too, each with its whole surroundings."""
    import numpy as np

    bits, full = 1 << 15, np.full(1 << 12, 255, np.uint8)
    sieve = L.Sieve({k: full for k in range(len(L.PARTS))}, {k: full for k in range(len(L.PARTS))}, bits)
    docs = [L.kept_text("abcdefghij" * 9), L.kept_text("x"), L.kept_text("klmnopqrst" * 8)]
    for k, doc, _, around in sieve.windows(docs):
        p = L.PARTS[k]
        assert around.shape[1] == p.block + 2 * p.run and set(doc) == {0, 1, 2}
