"""Detections against truths: IoU joins, greedy matching, suppression, COCO statistics and coverage.

Boxes of one image travel as arrays in one row, so Python sees batches of
images and never a row a box; what follows per class runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .ordering import running_totals

IOUS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
AREAS = {"all": (0, 1e10), "small": (0, 32**2), "medium": (32**2, 96**2), "large": (96**2, 1e10)}
STATS = ("ap", "ap50", "ap75", "ap_small", "ap_medium", "ap_large", "ar_1", "ar_10", "ar_100", "ar_small", "ar_medium", "ar_large")


def _box(p: str) -> tuple[Column, ...]:
    x, y = F.col(f"{p}x0"), F.col(f"{p}y0")
    return x, y, x + F.col(f"{p}w"), y + F.col(f"{p}h")


def iou_pairs(truths: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with a common area, equal in ``keys``, with their ``iou``; columns of the sides as given, boxes as t_/d_ x0, y0, w, h."""
    pairs = truths.join(detections, keys)
    return pairs.withColumn("iou", G.box_iou(_box("t_"), _box("d_"))).filter("iou > 0")


def per_image(truths: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys`` with the arrays ``t`` (x0, y0, w, h) and ``d`` (id, score, x0, y0, w, h), each in a fixed order."""
    box = ["x0", "y0", "w", "h"]
    t = truths.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", *box))), lambda s: F.array(*(s[c].cast("double") for c in box))).alias("t"))
    d = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", *(F.col(c).cast("double").alias(c) for c in box)))).alias("d"))
    return t.join(d, keys, "full").select(
        *keys, F.coalesce("t", F.array().cast("array<array<double>>")).alias("t"),
        F.transform("d", lambda s: F.array(-s["s"], s["x0"], s["y0"], s["w"], s["h"])).alias("d"), F.transform("d", lambda s: s["id"]).alias("ids"))


def iou_matrix(d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """IoU of every row of ``d`` with every row of ``t`` (x, y, w, h); 0 for an empty union."""
    if not len(d) or not len(t):
        return np.zeros((len(d), len(t)))
    x = np.minimum(d[:, None, 0] + d[:, None, 2], t[None, :, 0] + t[None, :, 2]) - np.maximum(d[:, None, 0], t[None, :, 0])
    y = np.minimum(d[:, None, 1] + d[:, None, 3], t[None, :, 1] + t[None, :, 3]) - np.maximum(d[:, None, 1], t[None, :, 1])
    inter = np.clip(x, 0, None) * np.clip(y, 0, None)
    union = (d[:, 2] * d[:, 3])[:, None] + (t[:, 2] * t[:, 3])[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def greedy(iou: np.ndarray, threshold: float) -> np.ndarray:
    """For each detection in order the truth it takes, or -1: the free one of greatest IoU, the first among equals, if above 0 and at the threshold."""
    taken, out = np.zeros(iou.shape[1], bool), np.full(iou.shape[0], -1)
    for k in range(iou.shape[0] if iou.shape[1] else 0):
        row = np.where(taken, -1.0, iou[k])
        j = int(row.argmax())
        if row[j] > 0 and row[j] >= threshold:
            taken[j], out[k] = True, j
    return out


def _arrays(x: object, width: int) -> np.ndarray:
    return np.array([list(r) for r in x], float).reshape(-1, width) if x is not None and len(x) else np.zeros((0, width))


def match_counts(truths: DataFrame, detections: DataFrame, keys: list[str], thresholds: list[float], iou: float = 0.5) -> DataFrame:
    """(*keys, threshold, tp, fp, fn) of greedy one-to-one matching in score order, at each score threshold."""
    rows = per_image(truths, detections, keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t, d = _arrays(r.t, 4), _arrays(r.d, 5)
                matrix = iou_matrix(d[:, 1:], t)
                for th in thresholds:
                    n = int((d[:, 0] >= th).sum())  # score order: the first n
                    tp = int((greedy(matrix[:n], iou) >= 0).sum())
                    out.append((*(getattr(r, k) for k in keys), th, tp, n - tp, len(t) - tp))
            yield pd.DataFrame(out, columns=[*keys, "threshold", "tp", "fp", "fn"])

    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", threshold double, tp int, fp int, fn int")


def precision_recall(counts: DataFrame, by: list[str], empty_recall: float = 0.0) -> DataFrame:
    """(*by, tp, fp, fn, precision, recall, f1, f2) with 0.0 for an empty denominator, ``empty_recall`` where there is no truth."""
    s = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b, e=0.0: F.when(b > 0, a / b).otherwise(F.lit(e))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty_recall)
    s = s.withColumn("precision", p).withColumn("recall", r)
    f = lambda b: ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall"))
    return s.withColumn("f1", f(1.0)).withColumn("f2", f(4.0))


def choose_thresholds(metrics: DataFrame, by: str, recall: float, precision: float) -> DataFrame:
    """(by, selected, reason): the highest threshold meeting both floors, else the one of greatest F2, the lower among equals."""
    ok = (F.col("recall") >= recall) & (F.col("precision") >= precision)
    s = metrics.groupBy(by).agg(F.max(F.when(ok, F.col("threshold"))).alias("best"), F.max_by("threshold", F.struct("f2", -F.col("threshold"))).alias("fallback"))
    return s.select(by, F.coalesce("best", "fallback").alias("selected"), F.when(F.col("best").isNotNull(), "floors_met").otherwise("max_f2_fallback").alias("reason"))


def suppress(detections: DataFrame, keys: list[str], iou: float = 0.3, top_k: int = 5000, keep: int = 750) -> DataFrame:
    """(*keys, id) of the detections kept by non-maximum suppression, best score first, ties by id."""
    none = detections.select(*keys, "id", "x0", "y0", "w", "h").limit(0)
    rows = per_image(none, detections, keys)
    kinds = {f.name: f.dataType.simpleString() for f in detections.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d = _arrays(r.d, 5)[:top_k, 1:]
                free, kept = np.ones(len(d), bool), []
                # each box that is kept strikes out those after it, so the work is kept x boxes and memory one row
                while len(kept) < keep and free.any():
                    k = int(free.argmax())
                    kept.append(k)
                    free &= iou_matrix(d[k : k + 1], d)[0] <= iou
                    free[: k + 1] = False
                out += [(*(getattr(r, c) for c in keys), r.ids[k]) for k in kept]
            yield pd.DataFrame(out, columns=[*keys, "id"])

    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", id {kinds['id']}")


def matched(iou: np.ndarray, counted: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(taken, counts), each ranges x thresholds x detections: whether a detection takes a truth, and whether one that counts.

    Detections come best first. Under every range of areas and every threshold each
    takes a truth that is still free and overlaps enough: one that counts in the
    range before one that does not, among those the one of greatest overlap. All
    ranges and thresholds are decided together, one detection after the other.
    """
    n, m = iou.shape
    free = np.ones((len(counted), len(thresholds), m), bool)
    taken, counts = np.zeros((2, len(counted), len(thresholds), n), bool)
    rows, cols = np.ogrid[: len(counted), : len(thresholds)]
    for k in range(n if m else 0):
        worth = np.where(free & (iou[k] >= thresholds[:, None]), iou[k] + 2.0 * counted[:, None, :], -1.0)
        best = worth.argmax(axis=2)
        found = np.take_along_axis(worth, best[..., None], 2)[..., 0] > 0
        free[rows, cols, best] &= ~found
        taken[:, :, k], counts[:, :, k] = found, found & counted[rows, best]
    return taken, counts


def coco_matches(truths: DataFrame, detections: DataFrame, image: str = "image_id", name: str = "class_id", most: int = 100) -> DataFrame:
    """One row a detection and area range: (class, area, score, place in its image, hits and ignored as bits over IOUS).

    Detections beyond the ``most`` best of an image and class take no part, as in
    the public evaluation's rules; a truth outside the area range is ignored, and
    so is an unmatched detection outside it.
    """
    rows = per_image(truths, detections, [image, name])
    limits, thresholds, bits = np.array(list(AREAS.values())), np.array(IOUS), 1 << np.arange(len(IOUS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t, d = _arrays(r.t, 4), _arrays(r.d, 5)[:most]
                within = lambda a: (a >= limits[:, :1]) & (a <= limits[:, 1:])
                taken, counts = matched(iou_matrix(d[:, 1:], t), within(t[:, 2] * t[:, 3]), thresholds)
                outside = ~within(d[:, 3] * d[:, 4])[:, None, :]
                hits = np.tensordot(bits, counts, (0, 1))
                ignored = np.tensordot(bits, (taken & ~counts) | (~taken & outside), (0, 1))
                cls, img = getattr(r, name), f"{getattr(r, image)}"
                for a, area in enumerate(AREAS):
                    out += zip([cls] * len(d), [area] * len(d), d[:, 0], [img] * len(d), range(len(d)), hits[a], ignored[a])
            yield pd.DataFrame(out, columns=["class_id", "area", "score", "image", "place", "hits", "ignored"])

    return rows.mapInPandas(run, "class_id int, area string, score double, image string, place int, hits int, ignored int")


def coco_statistics(truths: DataFrame, detections: DataFrame) -> DataFrame:
    """(class_id, *STATS): average precision and recall of each class in the twelve usual settings; -1 where a range holds no truth.

    Running true and false positives go over a class in score order, however many
    rows it has; the precision envelope needs only the best precision at each of
    the 101 recall points.
    """
    found = coco_matches(truths, detections)
    area = F.array(*(F.when((F.col("w") * F.col("h") >= lo) & (F.col("w") * F.col("h") <= hi), n) for n, (lo, hi) in AREAS.items()))
    truth = truths.select("class_id", F.explode(F.array_compact(area)).alias("area")).groupBy("class_id", "area").agg(F.count(F.lit(1)).alias("truth"))
    bit = lambda c: F.getbit(c, F.col("b")).cast("int")
    long = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(IOUS) - 1))).alias("b")).select("class_id", "area", "b", "score", "image", "place", bit("hits").alias("tp"), bit("ignored").alias("ig"))
    long = long.filter("ig = 0").withColumn("fp", 1 - F.col("tp")).withColumn("g", F.concat_ws("|", "class_id", "area", "b"))
    run = running_totals(long, "g", [F.desc("score"), F.col("image"), F.col("place")], {"ctp": "tp", "cfp": "fp"}).join(truth, ["class_id", "area"])
    point = run.withColumn("recall", F.col("ctp") / F.col("truth")).withColumn("precision", F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    reached = point.groupBy("class_id", "area", "b", F.floor(F.col("recall") * 100 + 1e-9).alias("slot")).agg(F.max("precision").alias("p"))
    slots = reached.groupBy("class_id", "area", "b").agg(F.map_from_entries(F.collect_list(F.struct("slot", "p"))).alias("m"))
    best = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda s: F.coalesce(F.array_max(F.transform(F.map_entries(F.map_filter("m", lambda k, v: k >= s)), lambda e: e["value"])), F.lit(0.0)))
    mean = F.aggregate(best, F.lit(0.0), lambda a, b: a + b) / 101
    ap = slots.select("class_id", "area", "b", mean.alias("ap"))
    ar = long.groupBy("class_id", "area", "b").agg(*(F.sum(F.when(F.col("place") < m, F.col("tp")).otherwise(0)).alias(f"n{m}") for m in (1, 10, 100)))
    bs = F.explode(F.sequence(F.lit(0), F.lit(len(IOUS) - 1))).alias("b")
    table = truth.select("class_id", "area", "truth", bs).join(ap, ["class_id", "area", "b"], "left").join(ar, ["class_id", "area", "b"], "left").na.fill(0)
    stat = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), F.lit(-1.0))
    of = lambda n: F.col("area") == n
    rec = lambda m: F.col(f"n{m}") / F.col("truth")
    cols = [
        stat(of("all"), F.col("ap")), stat(of("all") & (F.col("b") == 0), F.col("ap")), stat(of("all") & (F.col("b") == 5), F.col("ap")),
        *(stat(of(n), F.col("ap")) for n in ("small", "medium", "large")), *(stat(of("all"), rec(m)) for m in (1, 10, 100)),
        *(stat(of(n), rec(100)) for n in ("small", "medium", "large")),
    ]
    return table.groupBy("class_id").agg(*(c.alias(n) for c, n in zip(cols, STATS)))


def union_area(boxes: np.ndarray) -> float:
    """Area of a union of (x, y, w, h) boxes by coordinate compression."""
    return float(_cells(boxes, boxes)[0])


def _cells(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(area of the union of a, of the union of b, of what both cover)."""
    if len(a) <= 1 and len(b) <= 1:  # most images hold one box of a class a side
        p, q = (a[0].tolist() if len(a) else None), (b[0].tolist() if len(b) else None)
        x = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]) if p and q else 0.0
        y = min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]) if p and q else 0.0
        return p[2] * p[3] if p else 0.0, q[2] * q[3] if q else 0.0, max(x, 0.0) * max(y, 0.0)
    both = np.concatenate([a, b])
    xs, ys = np.unique(np.concatenate([both[:, 0], both[:, 0] + both[:, 2]])), np.unique(np.concatenate([both[:, 1], both[:, 1] + both[:, 3]]))
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]

    def cover(boxes: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(ys), len(xs)), int)
        for x, y, w, h in boxes:
            x0, x1, y0, y1 = np.searchsorted(xs, x), np.searchsorted(xs, x + w), np.searchsorted(ys, y), np.searchsorted(ys, y + h)
            grid[y0, x0] += 1
            grid[y1, x1] += 1
            grid[y0, x1] -= 1
            grid[y1, x0] -= 1
        return (grid.cumsum(0).cumsum(1) > 0)[:-1, :-1]

    ca, cb = cover(a), cover(b)
    return float(area[ca].sum()), float(area[cb].sum()), float(area[ca & cb].sum())


def coverage(truths: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, truth_area, covered_area, extra_area, truths, covered_truths): unions of boxes without pixels, exact.

    covered_truths counts truths of which 0.8 or more lies under the detections.
    """
    rows = per_image(truths, detections, keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t, d = _arrays(r.t, 4), _arrays(r.d, 5)[:, 1:]
                ta, da, both = _cells(t, d)
                well = sum(_cells(t[k : k + 1], d)[2] >= 0.8 * t[k, 2] * t[k, 3] for k in range(len(t))) if both else 0
                out.append((*(getattr(r, k) for k in keys), ta, both, da - both, len(t), int(well)))
            yield pd.DataFrame(out, columns=[*keys, "truth_area", "covered_area", "extra_area", "truths", "covered_truths"])

    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", truth_area double, covered_area double, extra_area double, truths int, covered_truths int")


def touching_components(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (*keys, id, x0, y0, w, h) with ``component``, the least id of the boxes that touch it directly or not, corners counting.

    Components stay within one value of ``keys``, whose boxes travel in one row.
    """
    box = ["x0", "y0", "w", "h"]
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *(F.col(c).cast("double").alias(c) for c in box)))).alias("b"))
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    rows = rows.select(*keys, F.transform("b", lambda s: s["id"]).alias("ids"), F.transform("b", lambda s: F.array(*(s[c] for c in box))).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                b = _arrays(r.b, 4)
                x0, y0, x1, y1 = b[:, 0], b[:, 1], b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]
                root = list(range(len(b)))

                def find(i: int, root: list[int] = root) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for k in range(len(b)):
                    near = np.flatnonzero((x0[:k] <= x1[k]) & (x0[k] <= x1[:k]) & (y0[:k] <= y1[k]) & (y0[k] <= y1[:k]))
                    for j in near.tolist():
                        p, q = find(j), find(k)
                        root[max(p, q)] = min(p, q)
                out += [(*(getattr(r, c) for c in keys), r.ids[k], r.ids[find(k)]) for k in range(len(b))]
            yield pd.DataFrame(out, columns=[*keys, "id", "component"])

    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", id {kinds['id']}, component {kinds['id']}")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` first rows of each group under ``order``."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
