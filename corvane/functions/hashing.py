"""Perceptual hashes, digests, run lengths and other column functions."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.cast("bigint").bitwiseXOR(b.cast("bigint")))


def hash_parts(h: Column, widths: tuple[int, ...]) -> list[Column]:
    """Disjoint parts of a hash from the lowest bit up, of the given widths."""
    return [F.shiftrightunsigned(h.cast("bigint"), sum(widths[:i])).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for i, w in enumerate(widths)]


def _median(a: Column, n: int) -> Column:
    ordered = F.array_sort(a)
    return (F.get(ordered, F.lit((n - 1) // 2)).cast("double") + F.get(ordered, F.lit(n // 2)).cast("double")) / 2


def bits_lsb_first(values: Column, n: int = 64) -> Column:
    """Hash of ``n`` values against the median of all but the first: bit k is value k, bit 0 always clear."""
    m = _median(F.slice(values, 2, n - 1), n - 1)
    bits = [F.when(F.get(values, F.lit(k)).cast("double") > m, F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(1, n)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bits_msb_first(values: Column, n: int = 64) -> Column:
    """Hash of ``n`` values against the same median, the first value highest and taken part; not interchangeable with the other."""
    m = _median(F.slice(values, 2, n - 1), n - 1)
    at = lambda k: n - 1 - k
    bits = [F.when(F.get(values, F.lit(k)).cast("double") > m, F.lit(1 << at(k) if at(k) < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(n)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hex_hash(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h.cast("bigint"))), 16, "0")


def hash_rank(seed: int, *key: Column) -> Column:
    """sha256 of ``seed:key``; a draw by it is repeatable and does not depend on partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *key), 256)


def stable_id(**fields: Column) -> Column:
    """First 20 hex digits of the sha256 of the fields as compact JSON with sorted keys."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 20)


# What a file name carries beside its asset, and where the name of a video ends in an asset.
EXPORT_TAG, ID_PREFIX = r"\.rf\.[0-9a-f]{16,}$", r"^[0-9a-f-]{36}___"
VIDEO_END = r"-?\b(?:(?:mp4|mov|avi)-?t|frame)-?[0-9]|(?<=^video-?[0-9]{1,18})-[0-9]+(?:-jpg)?$"


def asset_key(path: Column) -> Column:
    """The words of the file name, parted by hyphens, without extension, export tag and id prefix."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/", -1), -1)), r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, f"{EXPORT_TAG}|{ID_PREFIX}", "")
    return F.array_join(F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), F.lit(0)), "-")


def video_group(path: Column) -> Column:
    """What stands in ``asset_key`` before a time, a frame or the number of a still; '' where the name shows none of them."""
    key = asset_key(path)
    return F.substring(key, F.lit(1), F.greatest(F.regexp_instr(key, F.lit(VIDEO_END)) - 1, F.lit(0)))


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a - F.when(b > 0, (b / total) * F.log2(b / total)).otherwise(0.0))


def finite_number(c: Column) -> Column:
    """A string's finite number, else null; words for infinity and not-a-number are none."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def valid_interval(lower: Column, point: Column, upper: Column) -> Column:
    return F.coalesce((lower <= point) & (point <= upper), F.lit(False))


def rle_spans(runs: Column, width: Column) -> Column:
    """array<struct<start, length>> of the one runs of alternating zero and one run lengths, zeros first."""
    ends = F.transform(F.sequence(F.lit(0), F.greatest(F.size(runs) - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, b: a + b).alias("start"), F.get(runs, i).alias("length")))
    return F.filter(ends, lambda s: (s["i"] % 2 == 1) & (s["length"] > 0))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def rle_encode(mask: pd.Series) -> pd.Series:
    """Row-major run lengths of a flat array of zeros and ones, zeros first; an empty mask is [0]."""

    def one(flat: np.ndarray | None) -> list[int] | None:
        if flat is None:
            return None
        bits = (np.asarray(flat) > 0).astype(np.int8)
        if not len(bits):
            return [0]
        runs = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(bits)) + 1, [len(bits)]])).tolist()
        return [0, *runs] if bits[0] else runs

    return mask.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def rle_decode(runs: pd.Series) -> pd.Series:
    """The flat mask of run lengths; null where a length is negative."""

    def one(r: np.ndarray | None) -> list[int] | None:
        if r is None:
            return None
        lengths = np.asarray(r, dtype=np.int64)
        return None if (lengths < 0).any() else np.repeat(np.arange(len(lengths)) % 2, lengths).tolist()

    return runs.map(one)


def difference_hash(values: Column, rows: int = 8, columns: int = 9) -> Column:
    """Bits, first one highest, that tell whether a value exceeds its left neighbour in a ``rows`` x ``columns`` grid."""
    n, bits = rows * (columns - 1), []
    for k in range(n):
        at = k // (columns - 1) * columns + k % (columns - 1)
        place = n - 1 - k
        one = F.lit(1 << place if place < 63 else -(1 << 63)).cast("bigint")
        bits.append(F.when(F.get(values, F.lit(at + 1)) > F.get(values, F.lit(at)), one).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


@F.pandas_udf(T.DoubleType())
def mask_iou(left: pd.Series, right: pd.Series) -> pd.Series:
    """Intersection over union of two masks given as run lengths, without making the pixels; 0.0 for two empty masks, null if the sizes differ."""

    def one(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
        if a is None or b is None or sum(a) != sum(b):
            return None
        ea, eb = np.cumsum(a), np.cumsum(b)
        cuts = np.unique(np.concatenate([[0], ea, eb]))
        mid, size = cuts[:-1], np.diff(cuts)
        ma, mb = np.searchsorted(ea, mid, "right") % 2 == 1, np.searchsorted(eb, mid, "right") % 2 == 1
        union = size[ma | mb].sum()
        return float(size[ma & mb].sum() / union) if union else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=object)


@F.pandas_udf(T.StringType())
def pixel_digest(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
    """sha256 of width and height as eight little-endian bytes each, then the bytes."""
    head = lambda n: int(n).to_bytes(8, "little")
    return pd.Series([None if p is None else hashlib.sha256(head(w) + head(h) + bytes(p)).hexdigest() for w, h, p in zip(width, height, pixels)], dtype=object)


def brightness_contrast(values: Column) -> Column:
    """struct<brightness, contrast, dark, bright> of grey values in 0-255: mean, deviation, shares below 32 and above 223; nulls of an empty array."""
    n = F.nullif(F.size(values), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(values) / n
    var = total(F.transform(values, lambda v: (v - mean) * (v - mean))) / n
    share = lambda f: F.size(F.filter(values, f)) / n
    return F.struct(mean.alias("brightness"), F.sqrt(var).alias("contrast"), share(lambda v: v < 32).alias("dark"), share(lambda v: v > 223).alias("bright"))


@F.pandas_udf(T.StructType([T.StructField("laplacian_variance", T.DoubleType()), T.StructField("edge_density", T.DoubleType())]))
def sharpness(values: pd.Series, columns: pd.Series, limit: pd.Series) -> pd.DataFrame:
    """Of a flat grey grid with so many columns the variance of the Laplacian and the share of values whose gradient exceeds ``limit``.

    Differences of neighbours, at the border mirrored without repeating it; nulls
    of an empty or ragged grid. Grids of one shape are computed together.
    """
    out = np.full((len(values), 2), np.nan)
    sizes = np.array([0 if v is None else len(v) for v in values])
    for n, c, at in {(n, c, t) for n, c, t in zip(sizes.tolist(), columns, limit) if n and c and n % c == 0}:
        rows = np.flatnonzero((sizes == n) & (columns.to_numpy() == c) & (limit.to_numpy() == at))
        g = np.stack([np.asarray(values.iloc[k], float) for k in rows]).reshape(len(rows), n // c, c)
        pad = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(n // c, c) > 1 else "edge")
        up, down, left, right = pad[:, :-2, 1:-1], pad[:, 2:, 1:-1], pad[:, 1:-1, :-2], pad[:, 1:-1, 2:]
        out[rows, 0] = (up + down + left + right - 4 * g).var(axis=(1, 2))
        out[rows, 1] = (np.hypot(right - left, down - up) > at).mean(axis=(1, 2))
    return pd.DataFrame(out, columns=["laplacian_variance", "edge_density"]).astype(object).where(~np.isnan(out), None)


def _cosines(n: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of ``n`` values."""
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(0.5), 1.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def low_frequencies(grid: pd.Series) -> pd.Series:
    """The 8 x 8 lowest coefficients of the cosine transform of a flat 32 x 32 grey grid, row by row; null of any other size."""
    out, c = pd.Series([None] * len(grid), dtype=object), _cosines(32, 8)
    rows = [k for k, v in enumerate(grid) if v is not None and len(v) == 1024]
    if rows:
        g = np.stack([np.asarray(grid.iloc[k], float) for k in rows]).reshape(-1, 32, 32)
        for k, f in zip(rows, (c @ g @ c.T).reshape(-1, 64)):
            out.iloc[k] = f.tolist()
    return out


# The file suffix of an output by the format of its source, and of any other.
SUFFIXES, OTHER_SUFFIX = {"JPEG": ".jpg", "PNG": ".png", "WEBP": ".webp"}, ".png"


def output_suffix(source_format: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.upper(source_format)), F.lit(OTHER_SUFFIX))
