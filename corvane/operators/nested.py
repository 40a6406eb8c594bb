"""Problem 6: nested records as flat tables of records, instances, polygons and points.

Flattening works on Arrow buffers: a list column's offsets give its child array
and, for each child, the index of its parent; keys travel down by one vectorised
take. No row is visited in Python. Records that come as JSON documents of varying
shape are scanned as one buffer of bytes (``functions.json_arrays``): parent
indices of all their values tell, by the same kernels, which hold instances,
polygons and coordinates, and give the same nested Arrow type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_arrays import Values
from ..session import cut

INSTANCE = "struct<class_id:int,attr_id:string,bbox:array<double>,polygons:array<array<double>>>"


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """``values`` as ``n`` lists, each of those with its number in ``owner``, which is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _whole(numbers: pa.Array) -> pa.Array:
    x = numbers.to_numpy(zero_copy_only=False).astype(float)
    fine = np.isfinite(x) & (x == np.rint(x)) & (np.abs(x) < 2**31)
    return pa.array(np.where(fine, x, 0).astype(np.int32), mask=~fine)


class _Payloads:
    """The records in JSON documents of changing shape, whichever envelope they came in, as arrays over all documents of a batch."""

    def __init__(self, documents: pa.Array) -> None:
        v = self.v = Values(documents)
        self.n = len(documents)
        none = len(v.at)  # an extra row that stands for an absent value
        self.kind = np.append(v.kind, 0)
        self.of = {name: np.append(np.where((m := v.member(name)) < 0, none, m), none) for name in (
            "record", "image", "size", "width", "height", "image_id", "negative_for_profile", "annotations", "instances", "class_id", "attr_id", "bbox", "polygons", "points", "x", "y", "w", "h")}
        self.root = np.full(self.n, none)
        roots = np.flatnonzero(v.parent < 0)
        self.root[v.document[roots]] = roots
        self.root = np.where(self.is_object(self.root), self.root, none)
        inner = self.of["record"][self.root]
        self.body = np.where(self.is_object(inner), inner, self.root)

    def is_object(self, rows: np.ndarray) -> np.ndarray:
        return self.kind[rows] == ord("{")

    def is_list(self, rows: np.ndarray) -> np.ndarray:
        return self.kind[rows] == ord("[")

    def is_number(self, rows: np.ndarray) -> np.ndarray:
        k = self.kind[rows]
        return (k == ord("-")) | ((k >= ord("0")) & (k <= ord("9")))

    def children(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, which of ``parents`` each belongs to) of their entries and members; ``parents`` are different values."""
        which = np.full(len(self.kind), -1)
        which[parents] = np.arange(len(parents))
        which[-1] = -1  # an absent value has none
        of = np.where(self.v.parent >= 0, which[self.v.parent], -1)
        rows = np.flatnonzero(of >= 0)
        return rows, of[rows]

    def numbers(self, rows: np.ndarray) -> pa.Array:
        there = rows < len(self.v.at)
        found = self.v.numbers(rows[there])
        place = np.full(len(rows), -1)
        place[there] = np.arange(int(there.sum()))
        return found.take(pa.array(place, mask=~there))

    def strings(self, rows: np.ndarray) -> pa.Array:
        there = self.kind[rows] == ord('"')
        place = np.full(len(rows), -1)
        place[there] = np.arange(int(there.sum()))
        return self.v.strings(rows[there]).take(pa.array(place, mask=~there)).cast(pa.string())

    def header(self) -> dict[str, pa.Array]:
        of, body, none = self.of, self.body, len(self.kind) - 1
        image = np.where(self.is_object(of["image"][body]), of["image"][body], body)
        size = np.where(of["size"][image] < none, of["size"][image], of["size"][body])
        sides = []
        listed, which = self.children(np.unique(size[self.is_list(size)]))
        for k, side in enumerate(("width", "height")):
            at = np.full(len(self.kind), none)
            nth = listed[self.v.place[listed] == k]
            at[self.v.parent[nth]] = nth
            sides.append(np.where(self.is_object(size), of[side][size], np.where(self.is_list(size), at[size], of[side][image])))
        negative = np.where(of["negative_for_profile"][self.root] < none, of["negative_for_profile"][self.root], of["negative_for_profile"][body])
        flag = self.kind[negative]
        return {
            "image_id": self.strings(of["image_id"][image]), "width": _whole(self.numbers(sides[0])), "height": _whole(self.numbers(sides[1])),
            "negative_for_profile": pa.array(flag == ord("t"), mask=(flag != ord("t")) & (flag != ord("f"))),
        }

    def instances(self) -> pa.Array:
        """Of each document its instances, those of the body first, then those of its annotations in order."""
        of, body, none = self.of, self.body, len(self.kind) - 1
        notes = of["annotations"][body]
        docs = np.arange(self.n)
        entries, which = self.children(np.where(self.is_list(notes), notes, none)[self.is_list(notes)])
        owner = docs[self.is_list(notes)][which]
        plain = self.is_object(notes)
        holders = np.concatenate([body, notes[plain], entries])
        doc = np.concatenate([docs, docs[plain], owner])
        turn = np.concatenate([np.zeros(self.n, np.int64), np.ones(int(plain.sum()), np.int64), 1 + self.v.place[entries]])
        held = of["instances"][holders]
        keep = self.is_object(held) | self.is_list(held)
        rows, which = self.children(held[keep])
        order = np.lexsort([self.v.place[rows], turn[keep][which], doc[keep][which]])
        rows, doc = rows[order], doc[keep][which][order]
        there = self.is_object(rows)
        part = lambda name: np.where(there, of[name][rows], none)
        fields = [_whole(self.numbers(part("class_id"))), self.strings(part("attr_id")), self._boxes(part("bbox")), self._polygons(part("polygons"))]
        return _lists(pa.StructArray.from_arrays(fields, names=["class_id", "attr_id", "bbox", "polygons"], mask=pa.array(~there)), doc, self.n)

    def _boxes(self, box: np.ndarray) -> pa.Array:
        named, listed = np.flatnonzero(self.is_object(box)), np.flatnonzero(self.is_list(box))
        rows, which = self.children(box[listed])
        values = np.concatenate([*(self.of[k][box[named]] for k in "xywh"), rows])
        owner = np.concatenate([*([named] * 4), listed[which]])
        order = np.argsort(owner, kind="stable")
        return _lists(self.numbers(values[order]), owner[order], len(box))

    def _points(self, rows: np.ndarray) -> np.ndarray:
        """Whether values are points: lists of two numbers or objects with x and y."""
        none = len(self.kind) - 1
        pairs = np.flatnonzero(self.is_list(rows))
        inner, which = self.children(rows[pairs])
        count, numeric = np.bincount(which, minlength=len(pairs)), np.bincount(which[self.is_number(inner)], minlength=len(pairs))
        out = self.is_object(rows) & (self.of["x"][rows] < none) & (self.of["y"][rows] < none)
        out[pairs] = (count == 2) & (numeric == 2)
        return out

    def _polygons(self, held: np.ndarray) -> pa.Array:
        """Of each instance its polygons as flat lists; a polygon without the list around it is the only one."""
        none = len(self.kind) - 1
        containers = np.flatnonzero(self.is_object(held) | self.is_list(held))
        rows, which = self.children(held[containers])
        solid = self.kind[rows] != ord("n")
        count = lambda mask: np.bincount(which[mask], minlength=len(containers))
        filled = count(solid)
        bare = (filled > 0) & self.is_list(held[containers]) & ((count(solid & self.is_number(rows)) == filled) | (count(solid & self._points(rows)) == filled))
        bare |= self.is_object(held[containers]) & (self.of["points"][held[containers]] < none)
        kept = ~bare[which]
        polygon = np.concatenate([held[containers[bare]], rows[kept]])
        owner = np.concatenate([containers[bare], containers[which[kept]]])
        order = np.lexsort([polygon, owner])
        polygon, owner = polygon[order], owner[order]
        # Coordinates hang below their polygon by lists, by the points of an object and by the x and y of a point.
        mine = np.full(none + 1, -1)
        mine[polygon] = np.arange(len(polygon))
        mine[none] = -1
        parent = self.v.parent
        up = np.maximum(parent, 0)
        turn = np.zeros(none, np.int64)
        point = self.is_object(np.arange(none)) & (self.of["x"][:-1] < none) & (self.of["y"][:-1] < none) & (self.of["points"][:-1] == none)
        edge = (parent >= 0) & self.is_list(up) if none else np.zeros(0, bool)
        for name, place, inside in (("points", 0, self.is_object(np.arange(none)) & (self.of["points"][:-1] < none)), ("x", 0, point), ("y", 1, point)):
            child = self.of[name][:-1][inside]
            edge[child], turn[child] = True, place
        level = np.flatnonzero(mine[:-1] >= 0)
        found = [np.zeros(0, np.int64)]
        while len(level):
            below = np.zeros(none + 1, bool)
            below[level] = True
            level = np.flatnonzero(edge & below[up] & (parent >= 0))
            mine[level] = mine[parent[level]]
            scalar = ~(self.is_object(level) | self.is_list(level))
            found.append(level[scalar])
            level = level[~scalar]
        coordinate = np.concatenate(found)
        begin = np.where(turn[coordinate] + point[up[coordinate]] > 0, parent[coordinate], coordinate)  # x before y, whichever came first
        order = np.lexsort([turn[coordinate], begin, mine[coordinate]])
        coordinate = coordinate[order]
        flat = _lists(self.numbers(coordinate), mine[coordinate], len(polygon))
        return _lists(flat, owner, len(held))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = _Payloads(b.column("payload"))
        yield _batch({"row_id": b.column("row_id"), **p.header(), "instances": p.instances()})


_RECORD = f"row_id bigint, image_id string, width int, height int, negative_for_profile boolean, instances array<{INSTANCE}>"


def processed_as_records(processed: DataFrame) -> DataFrame:
    return processed.select("row_id", "image_id", "width", "height", "negative_for_profile", "instances")


def payloads_as_records(payloads: DataFrame) -> DataFrame:
    """The JSON documents of ``payloads`` (payload_id, payload) as records of the common nested type."""
    sound = F.when(F.from_json("payload", "map<string,string>").isNotNull(), F.col("payload"))  # the JVM's parser refuses what is no JSON object
    return payloads.select(F.col("payload_id").alias("row_id"), sound.alias("payload")).mapInArrow(_parse, _RECORD)


def children(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(child array, parent index of each child, place of each child in its parent) of a list array."""
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(parent, minlength=len(lists))
    return pc.list_flatten(lists), parent, np.arange(len(parent)) - (np.cumsum(counts) - counts)[parent]


class _Level:
    """The arrays of one batch at each level of nesting."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.row_id = b.column("row_id")
        self.inst, self.inst_parent, self.inst_no = children(b.column("instances"))
        self.inst_there = self.inst.is_valid().to_numpy(zero_copy_only=False)
        self.poly, self.poly_parent, self.poly_no = children(pc.struct_field(self.inst, "polygons"))
        self.coord, self.coord_parent, self.coord_no = children(self.poly)
        filled = self.coord.is_valid().to_numpy(zero_copy_only=False)
        self.poly_there = np.bincount(self.coord_parent[filled], minlength=len(self.poly)) > 0


def _places(b: pa.RecordBatch) -> pa.RecordBatch:
    x = _Level(b)
    polys = np.flatnonzero(x.poly_there)
    of = x.poly_parent[polys]
    bare = x.inst_there & (np.bincount(of, minlength=len(x.inst)) == 0)
    empty = np.flatnonzero(np.bincount(x.inst_parent[x.inst_there], minlength=len(b)) == 0)
    parents = np.concatenate([x.inst_parent[of], x.inst_parent[bare], empty])
    none = np.full(len(empty), -1)
    inst_no = np.concatenate([x.inst_no[of], x.inst_no[bare], none])
    poly_no = np.concatenate([x.poly_no[polys], np.full(int(bare.sum()), -1), none])
    return _batch({"row_id": x.row_id.take(pa.array(parents)), "instance_no": pa.array(inst_no, pa.int32()), "polygon_no": pa.array(poly_no, pa.int32())})


def _instances(b: pa.RecordBatch) -> pa.RecordBatch:
    x = _Level(b)
    there = pa.array(np.flatnonzero(x.inst_there))
    inst = x.inst.take(there)
    box, parent, no = children(pc.struct_field(inst, "bbox"))
    sides = {}
    for k, side in enumerate("xywh"):
        at = np.flatnonzero(no == k)
        spot = np.full(len(inst), -1)
        spot[parent[at]] = at
        sides[f"bbox_{side}"] = box.take(pa.array(spot, mask=spot < 0))
    return _batch({
        "row_id": x.row_id.take(pa.array(x.inst_parent[x.inst_there])), "instance_no": pa.array(x.inst_no[x.inst_there], pa.int32()),
        "class_id": pc.struct_field(inst, "class_id").cast(pa.int32()), "attr_id": pc.struct_field(inst, "attr_id").cast(pa.string()), **sides,
    })


def _polygon_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    x = _Level(b)
    polys = np.flatnonzero(x.poly_there)
    of = x.poly_parent[polys]
    points = (np.bincount(x.coord_parent, minlength=len(x.poly)) + 1) // 2
    return _batch({"row_id": x.row_id.take(pa.array(x.inst_parent[of])), "instance_no": pa.array(x.inst_no[of], pa.int32()), "polygon_no": pa.array(x.poly_no[polys], pa.int32()), "n_points": pa.array(points[polys], pa.int32())})


def _points(b: pa.RecordBatch) -> pa.RecordBatch:
    x = _Level(b)
    first = np.flatnonzero((x.coord_no % 2 == 0) & x.poly_there[x.coord_parent])
    poly = x.coord_parent[first]
    second = first + 1
    paired = (second < len(x.coord)) & (x.coord_parent[np.minimum(second, max(len(x.coord) - 1, 0))] == poly) if len(x.coord) else np.zeros(0, bool)
    inst = x.poly_parent[poly]
    return _batch({
        "row_id": x.row_id.take(pa.array(x.inst_parent[inst])), "instance_no": pa.array(x.inst_no[inst], pa.int32()), "polygon_no": pa.array(x.poly_no[poly], pa.int32()),
        "point_no": pa.array(x.coord_no[first] // 2, pa.int32()), "x": x.coord.take(pa.array(first)), "y": x.coord.take(pa.array(second, mask=~paired)),
    })


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _flat(kernel: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield kernel(b)

    return run


_KEYS = "row_id bigint, instance_no int"
TABLES = {
    "places": (_places, f"{_KEYS}, polygon_no int"),
    "instances": (_instances, f"{_KEYS}, class_id int, attr_id string, bbox_x double, bbox_y double, bbox_w double, bbox_h double"),
    "polygons": (_polygon_rows, f"{_KEYS}, polygon_no int, n_points int"),
    "points": (_points, f"{_KEYS}, polygon_no int, point_no int, x double, y double"),
}


def flatten(records: DataFrame, which: str) -> DataFrame:
    """One flat table of ``records`` (row_id, instances array<struct<... bbox, polygons ...>>).

    which: ``instances``, ``polygons``, ``points``, or ``places``, the outline of
    all: one row a polygon that has coordinates, one with polygon_no -1 for an
    instance without any, one with -1, -1 for a record without a non-null
    instance. Numbers count from 0 as delivered; null and empty entries keep
    their number and are not listed. A last coordinate without a partner is a
    point whose y is null. Every child row names its parents; rows are never merged.
    """
    kernel, schema = TABLES[which]
    slim = records.select("row_id", "instances")
    return slim.mapInArrow(_flat(kernel), schema)


def flat_records(records: DataFrame) -> DataFrame:
    """(row_id, image_id, width, height, negative_for_profile, instances), the last being the number of non-null instances."""
    n = F.coalesce(F.size(F.filter("instances", lambda i: i.isNotNull())), F.lit(0))
    return records.select("row_id", "image_id", "width", "height", "negative_for_profile", F.when(n < 0, 0).otherwise(n).alias("n_instances"))


def both_sources(processed: DataFrame, payloads: DataFrame, which: str) -> DataFrame:
    """A flat table of both deliveries, with source_table naming the one a row comes from; which as in ``flatten``, or ``records``."""
    make = flat_records if which == "records" else lambda df: flatten(df, which)
    tag = lambda df, name: make(df).select(F.lit(name).alias("source_table"), "*")
    return tag(processed_as_records(processed), "processed_records").unionByName(tag(payloads_as_records(payloads), "record_payloads"))


def all_tables(processed: DataFrame, payloads: DataFrame) -> dict[str, DataFrame]:
    """``records``, ``instances``, ``polygons``, ``points`` and ``places`` of both deliveries, the documents being scanned once for all of them."""
    one, two = processed_as_records(processed), cut(payloads_as_records(payloads))

    def both(which: str) -> DataFrame:
        make = flat_records if which == "records" else lambda df: flatten(df, which)
        tag = lambda df, name: make(df).select(F.lit(name).alias("source_table"), "*")
        return tag(one, "processed_records").unionByName(tag(two, "record_payloads"))

    return {which: both(which) for which in ("records", *TABLES)}
