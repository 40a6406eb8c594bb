"""Column functions over boxes, polygons and image sizes.

Boxes are given as columns; a null argument gives a null result unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _safe(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d)


def geometry_status(sw: Column, sh: Column, dw: Column, dh: Column, tolerance: float = 0.01) -> Column:
    """``aligned_resize``, ``rotation_candidate`` or ``geometry_mismatch`` by log ratio of the aspect ratios; null if a size is below 1."""
    if not 0 < tolerance < 0.25:
        raise ValueError(f"no aspect tolerance: {tolerance}")
    source, decoded, limit = sw / sh, dw / dh, F.log1p(F.lit(tolerance))
    status = F.when(F.abs(F.log(decoded / source)) <= limit, "aligned_resize").when(F.abs(F.log(decoded * source)) <= limit, "rotation_candidate").otherwise("geometry_mismatch")
    return F.when((sw >= 1) & (sh >= 1) & (dw >= 1) & (dh >= 1), status)


def release_geometry(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    """``exact``, ``rotated``, ``aligned_resize`` (ratios within 0.01 of each other) or ``mismatch``."""
    return F.when((sw == dw) & (sh == dh), "exact").when((sw == dh) & (sh == dw), "rotated").when(F.abs(sw / sh - dw / dh) <= 0.01, "aligned_resize").otherwise("mismatch")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, (int, float)) else low, F.least(F.lit(high) if isinstance(high, (int, float)) else high, x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def scaled_polygon(polygon: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """Scaled, clamped to [0, side - 1] and rounded to 3 places; null if not three whole, finite pairs or more."""
    ok = (F.size(polygon) >= 6) & (F.size(polygon) % 2 == 0) & F.forall(polygon, is_finite)
    scaled = F.transform(polygon, lambda v, i: F.round(F.when(i % 2 == 0, clamp(v * sx, 0.0, width - 1.0)).otherwise(clamp(v * sy, 0.0, height - 1.0)), 3))
    return F.when(ok, scaled)


def scaled_bbox(x: Column, y: Column, w: Column, h: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """struct<x, y, w, h>: left and top clamped to the last pixel, right and bottom to the edge; rounded to 3 places."""
    left, top = clamp(x * sx, 0.0, width - 1.0), clamp(y * sy, 0.0, height - 1.0)
    right, bottom = clamp((x + w) * sx, left, width.cast("double")), clamp((y + h) * sy, top, height.cast("double"))
    return F.struct(F.round(left, 3).alias("x"), F.round(top, 3).alias("y"), F.round(right - left, 3).alias("w"), F.round(bottom - top, 3).alias("h"))


def polygon_area(polygon: Column) -> Column:
    """Shoelace area of a flat x, y list; 0 for fewer than two points."""
    n = F.floor(F.size(polygon) / 2).cast("int")
    at = lambda k: F.get(polygon, k.cast("int"))
    terms = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: at(2 * i) * at(2 * ((i + 1) % n) + 1) - at(2 * ((i + 1) % n)) * at(2 * i + 1))
    return F.when(n > 0, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))) / 2).otherwise(F.lit(0.0))


def source_area(areas: Column, scalar: Column, polygons: Column) -> Column:
    """The sum of a list of areas, else the scalar, else the polygons' areas."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return F.coalesce(total(areas), scalar.cast("double"), total(F.transform(polygons, polygon_area)))


def resized_shape(height: Column, width: Column, short_side: int | None, long_side: int | None) -> Column:
    """struct<height, width> after scaling the short side, then capping the long one; halves round to even."""
    scale = F.lit(float(short_side)) / F.least(height, width) if short_side else F.lit(1.0)
    if long_side:
        scale = F.when(F.greatest(height, width) * scale > long_side, F.lit(float(long_side)) / F.greatest(height, width)).otherwise(scale)
    side = lambda s: F.greatest(F.lit(1), F.rint(s * scale)).cast("int")
    return F.struct(side(height).alias("height"), side(width).alias("width"))


def size_bucket(area: Column) -> Column:
    """``small`` below 32 x 32 pixels, ``medium`` below 96 x 96, else ``large``."""
    return F.when(area < 32 * 32, "small").when(area < 96 * 96, "medium").when(area.isNotNull(), "large")


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area of two boxes given as (x0, y0, x1, y1)."""
    zero = F.lit(0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x0, y0, x1, y1) boxes; 0.0 where the union is empty."""
    inter = overlap_area(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def rectangle_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y, x + w, y + h, x, y + h)


def expanded_box(x0: Column, y0: Column, x1: Column, y1: Column, fraction: float, width: Column, height: Column) -> Column:
    """Half-open pixel box struct<x0, y0, x1, y1>: expanded on each side, floor and ceiling, clipped to the image."""
    dx, dy = (x1 - x0) * fraction, (y1 - y0) * fraction
    return F.struct(
        F.greatest(F.lit(0), F.floor(x0 - dx)).cast("int").alias("x0"), F.greatest(F.lit(0), F.floor(y0 - dy)).cast("int").alias("y0"),
        F.least(width, F.ceil(x1 + dx)).cast("int").alias("x1"), F.least(height, F.ceil(y1 + dy)).cast("int").alias("y1"),
    )


def tile_origins(extent: Column, tile: Column, step: Column) -> Column:
    """Offsets of tiles covering ``extent``, the last one flush with the end."""
    regular = F.sequence(F.lit(0), F.greatest(extent - tile, F.lit(0)), step)
    return F.when(extent <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(extent - tile))))


def tile_plan(width: Column, height: Column, tile_size: int = 768, overlap: float = 0.25, min_side: int = 1024, max_tiles: int = 24) -> Column:
    """array<struct<x0, y0, x1, y1>>, row by row; the tile grows by half until at most ``max_tiles`` are needed.

    Images whose longer side is below ``min_side``, or that one tile covers, need none.
    """
    if tile_size < 64 or not 0 <= overlap < 0.9 or max_tiles < 1:
        raise ValueError("tile_size of 64 or more, overlap in [0, 0.9) and a positive max_tiles are needed")
    sizes = [tile_size]
    while sizes[-1] < 1 << 17:
        sizes.append(int(sizes[-1] * 1.5))
    plans = None
    for tile in reversed(sizes):
        step = F.lit(max(1, round(tile * (1 - overlap))))
        count = lambda e, tile=tile, step=step: F.when(e <= tile, F.lit(1)).otherwise(F.ceil((e - tile) / step).cast("int") + 1)
        fits = (count(width) * count(height) <= max_tiles) | (F.lit(tile) >= F.greatest(width, height))
        plans = F.lit(tile) if plans is None else F.when(fits, F.lit(tile)).otherwise(plans)
    tile = plans
    step = F.greatest(F.lit(1), F.rint(tile * (1 - overlap)).cast("int"))
    xs, ys = tile_origins(width, F.least(tile, width), step), tile_origins(height, F.least(tile, height), step)
    tiles = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x0"), y.alias("y0"), F.least(x + tile, width).alias("x1"), F.least(y + tile, height).alias("y1")))))
    return F.when((F.greatest(width, height) < min_side) | (F.size(tiles) <= 1), F.slice(tiles, 1, 0)).otherwise(tiles)


def tile_to_image(box: tuple[Column, ...], left: Column, top: Column, width: Column, height: Column) -> Column:
    """A tile's box in image coordinates, clipped; null where nothing is left of it."""
    x0, y0, x1, y1 = F.least(width, box[0] + left), F.least(height, box[1] + top), F.least(width, box[2] + left), F.least(height, box[3] + top)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
