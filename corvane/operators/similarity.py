"""Near-equal hashes by lists of equal blocks, exact by the pigeonhole rule and as selective as the data need."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..skew import salted_join

#: Hashes that are compared in one task at most, and about how many share a cell where blocks are wide enough for it.
CELL_ROWS, CELL_MEAN = 1 << 20, 1 << 12


class Blocks(NamedTuple):
    """``masks`` of the blocks a hash is cut into, and how many of them two near hashes have equal at least."""

    masks: tuple[int, ...]
    equal: int


def block_plan(hashes: int, max_distance: int, bits: int = 64) -> Blocks:
    """Blocks for so many distinct hashes: ``max_distance + k`` blocks, of which hashes that near have ``k`` equal.

    k is the least for which the bits of k blocks tell as many values apart as
    there are hashes. So a hash meets about one other in each list by chance,
    however many there are, and candidates grow with the hashes and not with their
    square. The result is the same for every k.
    """
    k = 1
    while k < bits - max_distance and 2.0 ** (bits * k / (max_distance + k)) < hashes:
        k += 1
    n = max_distance + k
    widths = [bits // n + (i < bits % n) for i in range(n)]
    return Blocks(tuple(((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)), k)


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


def block_lists(hashes: DataFrame, name: str, plan: Blocks) -> DataFrame:
    """Postings of the hashes in column ``name``, one for each choice of ``plan.equal`` blocks: (*, key, chosen, upto).

    chosen has a bit for each block of the list, upto for each block up to its
    last; key is the list. Two hashes in one list by a collision of keys are told
    apart by ``first_equal``.
    """
    lists = [
        F.struct(
            _signed(sum(plan.masks[b] for b in blocks)).alias("mask"), F.lit(sum(1 << b for b in blocks)).cast("bigint").alias("chosen"),
            F.lit((2 << blocks[-1]) - 1).cast("bigint").alias("upto"),
        )
        for blocks in combinations(range(len(plan.masks)), plan.equal)
    ]
    rows = hashes.select("*", F.explode(F.array(*lists)).alias("_list")).select(*hashes.columns, "_list.*")
    return rows.withColumn("key", F.xxhash64("chosen", F.col(name).bitwiseAND(F.col("mask")))).drop("mask")


def first_equal(g: Column, h: Column, plan: Blocks) -> Column:
    """Whether the list (chosen, upto) is that of the first equal blocks of ``g`` and ``h``: each near pair has one such list."""
    differ, equal = g.bitwiseXOR(h), F.lit(0).cast("bigint")
    for b, mask in enumerate(plan.masks):
        equal = equal.bitwiseOR(F.when(differ.bitwiseAND(_signed(mask)) == 0, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return equal.bitwiseAND(F.col("upto")) == F.col("chosen")


def cell_rows(hashes: DataFrame, plan: Blocks, rows: int) -> DataFrame:
    """(h, side, cell, lo, hi, part): each of the ``rows`` hashes once for every block that can be the first of a list, in the cell of that block's value.

    Lists are opened within their cell, so this is all that is shuffled, however
    many lists there are. A cell of more than ``CELL_ROWS`` hashes is dealt into
    parts, each two of which meet in one (lo, hi); the cells, bounded in number by
    how they are made, are counted first.
    """
    wide = min(8, max(0, (rows // CELL_MEAN).bit_length()))
    cells = []
    for b, mask in enumerate(plan.masks[: len(plan.masks) - plan.equal + 1]):
        low = (mask & -mask).bit_length() - 1
        value = F.shiftrightunsigned(F.col("h"), low).bitwiseAND(F.lit(min(mask >> low, (1 << wide) - 1)).cast("bigint"))
        cells.append((value + (b << 8)).cast("int"))
    postings = hashes.select("h", "side", F.explode(F.array(*cells)).alias("cell"))
    sizes = {r["cell"]: r["count"] for r in postings.groupBy("cell").count().collect()} if rows > CELL_ROWS else {}
    dealt: dict[int, list[int]] = {}
    for cell, n in sizes.items():
        if n > CELL_ROWS:
            dealt.setdefault(-(-n // CELL_ROWS), []).append(cell)
    one = F.lit(0)
    out = postings.filter(~F.col("cell").isin([c for cs in dealt.values() for c in cs])) if dealt else postings
    out = out.select("h", "side", "cell", one.alias("lo"), one.alias("hi"), one.alias("part"))
    for parts, own in dealt.items():
        part = F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")
        some = postings.filter(F.col("cell").isin(own)).withColumn("part", part).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = out.unionByName(some.select("h", "side", "cell", F.least("part", "_o").alias("lo"), F.greatest("part", "_o").alias("hi"), "part"))
    return out


def _near_in_cell(h: np.ndarray, part: np.ndarray, first: int, plan: Blocks, max_distance: int, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, distances) of the near pairs of a cell whose first ``plan.equal`` equal blocks begin with ``first``.

    A list is the order of the hashes by its blocks; equal ones are met at growing
    distance in that order, so no step holds more than a row for each hash.
    """
    masks = np.array(plan.masks, np.uint64)
    for rest in combinations(range(first + 1, len(masks)), plan.equal - 1):
        chosen = (first, *rest)
        key = h & np.bitwise_or.reduce(masks[list(chosen)])
        order = np.argsort(key)
        key, x = key[order], h[order]
        before = [masks[b] for b in range(chosen[-1]) if b not in chosen]
        at, step = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):
            differ = x[at] ^ x[at + step]
            bits = np.bitwise_count(differ)
            keep = np.flatnonzero(bits <= max_distance)
            if len(keep):
                apart = differ[keep]
                ok = np.ones(len(keep), bool)
                for mask in before:
                    ok &= apart & mask != 0
                i, j = order[at[keep]], order[at[keep] + step]
                if across:
                    ok &= part[i] != part[j]
                if ok.any():
                    yield i[ok], j[ok], bits[keep][ok].astype(np.int32)
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]


def near_hash_pairs(left: DataFrame, right: DataFrame, max_distance: int, bits: int = 64) -> DataFrame:
    """(g, h, distance) of the distinct non-null hashes of ``left`` (h) and ``right`` (h), at most ``max_distance`` bits apart.

    Both sides are reduced to their distinct values first, written once; equal
    hashes are a pair with distance 0. The others meet in cells (``cell_rows``),
    whose lists are opened by sorting; nothing is joined, so nothing is broadcast
    on a wrong estimate of the lists' size.
    """
    side = lambda df, k: df.filter("h is not null").select(F.col("h").cast("bigint").alias("h"), F.lit(k).alias("side"))
    both = side(left, 3).distinct() if left is right else side(left, 1).unionByName(side(right, 2)).groupBy("h").agg(F.bit_or("side").alias("side"))
    x = cut(both)
    rows = x.count()
    plan = block_plan(rows, max_distance, bits)

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, lo, hi = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches))
        h, sides, part = (t[c].to_numpy() for c in ("h", "side", "part"))
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["g", "h", "distance"])

        for i, j, d in _near_in_cell(h.view(np.uint64), part, cell >> 8, plan, max_distance, lo < hi):
            for a, b in ((i, j), (j, i)):
                ok = (sides[a] & 1 > 0) & (sides[b] & 2 > 0)
                found.append((h[a][ok], h[b][ok], d[ok]))
            held += 2 * len(i)
            if held >= 1 << 16:
                yield batch()
                found.clear()
                held = 0
        if found:
            yield batch()

    met = cell_rows(x, plan, rows).groupBy("cell", "lo", "hi").applyInArrow(pairs, "g bigint, h bigint, distance int")
    return met.unionByName(x.filter("side = 3").select(F.col("h").alias("g"), "h", F.lit(0).alias("distance")))


def _unsized_join(pairs: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``salted_join`` of pairs whose number Spark cannot estimate, so that neither side is broadcast on a guess."""
    return salted_join(pairs.hint("merge"), right, key)


def near_images_across_splits(images: DataFrame, max_distance: int) -> DataFrame:
    """(left_image_id, left_split, right_image_id, right_split, g, h, distance) of images whose splits differ and whose hashes are at most ``max_distance`` bits apart.

    ``images`` has image_id, split, sha256 and h; rows without h or split match
    nothing. Each pair comes out once, left_split < right_split, and not if both
    have the same sha256; an unknown sha256 equals none. Hashes are paired first,
    then (hash, split), then contents, and only what is left is expanded to images.
    """
    place = F.concat_ws(":", F.col("h").cast("string"), "split")
    x = images.filter("h is not null and split is not null").select("image_id", "split", "sha256", "h", place.alias("place"))
    x = cut(x.withColumn("content", F.concat_ws(":", "place", F.coalesce("sha256", F.lit("")))).distinct())
    sides, contents = x.select("h", "split", "place").distinct(), x.select("place", "content", "sha256").distinct()
    pairs = cut(near_hash_pairs(x, x, max_distance))
    pairs = _unsized_join(pairs, sides.toDF("g", "left_split", "left_place"), "g")
    pairs = cut(_unsized_join(pairs, sides.toDF("h", "right_split", "right_place"), "h").filter("left_split < right_split"))
    pairs = _unsized_join(pairs, contents.toDF("left_place", "left_content", "left_sha256"), "left_place")
    pairs = _unsized_join(pairs, contents.toDF("right_place", "right_content", "right_sha256"), "right_place")
    pairs = cut(pairs.filter("left_sha256 is null or right_sha256 is null or left_sha256 <> right_sha256"))
    pairs = _unsized_join(pairs, x.select(F.col("content").alias("left_content"), F.col("image_id").alias("left_image_id")), "left_content")
    pairs = _unsized_join(pairs, x.select(F.col("content").alias("right_content"), F.col("image_id").alias("right_image_id")), "right_content")
    return pairs.select("left_image_id", "left_split", "right_image_id", "right_split", "g", "h", "distance").distinct()
