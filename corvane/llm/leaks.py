"""Problem 7: passages of evaluation items inside documents.

MinHash containment search, partitioned by the size of the items. A stretch of
``run`` kept characters of an item holds a whole block of the item: of a short
item the middle, which every such stretch covers, of a longer one a block of half
the stretch. The query sets are the character shingles of these blocks, longer
blocks for the partition of short items. The domains are the windows of the
documents, for each partition of exactly its block's length: a block inside a
document then equals a domain of its own size, the containment asked for is the
Jaccard similarity 1, and at that similarity one band of BAND minimum values finds
the pair with certainty, however long the document.

A document's windows first pass a Bloom filter of the bands of all items, bounded
in size; what passes goes with its surroundings to a join on the band, and there
the shingles of the block must be contained in the window in their places, and the
stretch around it reach the length asked for. Documents are read once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..skew import salted_join

WIDE_LANGS = ("zh", "ja")


class Part(NamedTuple):
    """A partition of items: their script, the kept characters a case needs, the least size, and block and shingle length."""

    wide: bool
    run: int
    least: int
    block: int
    shingle: int


# Any stretch of ``run`` characters of an item of ``least`` or more holds a whole block: for items below 5/4 of the
# run all of them cover the 2 x run - size characters in the middle; beyond, 2 x block - 1 characters hold one.
PARTS = (Part(False, 60, 60, 45, 8), Part(False, 60, 76, 30, 8), Part(True, 25, 25, 19, 5), Part(True, 25, 32, 13, 5))
#: Minimum values in the one band.
BAND = 2
#: Bits of a filter for each block of an item, and at most (4 MB a filter); beyond that more passes, and nothing is lost.
FILTER_BITS, MOST_BITS = 32, 1 << 25
#: Code points handled at once, and windows looked at closely at once.
SLICE, CLOSE = 1 << 19, 1 << 13
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BASE = 0x100000001B3

_kept: np.ndarray | None = None


def kept_characters() -> np.ndarray:
    """Whether a code point is a letter, mark or digit (Unicode L, M, N)."""
    global _kept
    if _kept is None:
        _kept = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)
    return _kept


def kept_text(text: str) -> np.ndarray:
    """The kept code points of ``text`` in NFKC form and lower case."""
    codes = np.frombuffer(unicodedata.normalize("NFKC", text).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[kept_characters()[codes]]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each ``q`` consecutive codes, put together from hashes of powers of two."""
    power, size, out, done = codes.astype(np.uint64), 1, None, 0
    while True:
        if q & size:
            n = len(codes) - done - size + 1
            out = power if out is None else out[: max(n, 0)] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + max(n, 0)]
            done += size
        if size * 2 > q:
            return out[: max(len(codes) - q + 1, 0)]
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:] if len(power) > size else power[:0]
        size *= 2


class _Minima:
    """Minimum of each ``w`` neighbours for several ``w``, from minima of powers of two made once."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]

    def over(self, w: int) -> np.ndarray:
        k = w.bit_length() - 1
        while len(self.levels) <= k:
            low, size = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0])
        low, size, n = self.levels[k], 1 << k, max(len(self.levels[0]) - w + 1, 0)
        return np.minimum(low[:n], low[w - size : w - size + n]) if n else low[:0]


def bands(codes: np.ndarray, part: int, at: np.ndarray | None = None, first: np.ndarray | None = None, shingled: np.ndarray | None = None) -> np.ndarray:
    """The band of the window that starts at each place of ``at`` (of every window if not given)."""
    p = PARTS[part]
    h = shingles(codes, p.shingle) if shingled is None else shingled
    w = p.block - p.shingle + 1
    if at is None:
        at = np.arange(max(len(codes) - p.block + 1, 0))
    out = _Minima(_mix(h, _SEEDS[0])).over(w)[at] if first is None else first
    near = h[at[:, None] + np.arange(w)] if len(at) else np.zeros((0, w), np.uint64)
    for seed in _SEEDS[1:BAND]:
        out = _mix(out, 1) ^ _mix(near, seed).min(axis=1, initial=np.iinfo(np.uint64).max)
    return _mix(out, part + 2)


def filter_bits(first: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(first, 5) & np.uint64(bits - 1)).astype(np.int64)


def _surroundings(codes: np.ndarray, at: np.ndarray, p: Part) -> np.ndarray:
    """Codes from ``run`` before to ``run`` after each block, one row a block; ``codes`` must be padded by that much."""
    return codes[at[:, None] + np.arange(-p.run, p.block + p.run)]


def _strings(rows: np.ndarray) -> list[str]:
    width = rows.shape[1] if rows.ndim == 2 else 0
    text = np.ascontiguousarray(rows, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + width] for i in range(0, len(text), width)] if width else []


def _item_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, band, first, item_id, around) of the blocks of each item, alike ones of an item once."""
    for pdf in batches:
        out = []
        for item_id, wide, text in zip(pdf["item_id"], pdf["wide"], pdf["text"]):
            codes = kept_text(text)
            fits = [k for k, p in enumerate(PARTS) if p.wide == wide and len(codes) >= p.least]
            if not fits:
                continue
            p = PARTS[fits[-1]]
            own = np.concatenate([np.ones(p.run, np.uint32), codes, np.ones(p.run, np.uint32)])  # a code that is never kept
            middle = len(codes) < PARTS[fits[0]].run * 5 // 4 + 1
            at = p.run + (np.array([len(codes) - p.run]) if middle else np.arange(0, len(codes) - p.block + 1, p.block))
            at = at[np.unique(_surroundings(own, at, p), axis=0, return_index=True)[1]]
            h = shingles(own, p.shingle)
            first = _Minima(_mix(h, _SEEDS[0])).over(p.block - p.shingle + 1)[at]
            band = bands(own, fits[-1], at, first, h)
            out += zip([fits[-1]] * len(at), band.view(np.int64).tolist(), first.view(np.int64).tolist(), [item_id] * len(at), _strings(_surroundings(own, at, p)))
        yield pd.DataFrame(out, columns=["part", "band", "first", "item_id", "around"])


class Sieve:
    """Windows of documents whose first minimum and whose band pass the filters, one set of bits for each partition."""

    def __init__(self, firsts: dict[int, np.ndarray], bands_: dict[int, np.ndarray], bits: int) -> None:
        """firsts and bands_: packed bits, set for the blocks of a partition."""
        self.bits = bits
        self.firsts, self.bands = firsts, bands_

    def _passes(self, packed: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = filter_bits(values, self.bits)
        return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def windows(self, docs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, position of the document, band, surroundings) of what passes, alike ones of a document mostly once."""
        gap = max(p.run for p in PARTS)
        empty = np.zeros(gap, np.uint32)  # a code that is never kept: no block reaches across
        longest = max(p.block for p in PARTS)
        codes = np.concatenate([x for d in docs for x in (empty, d)] + [empty, empty[:longest]])
        starts = np.cumsum([0] + [len(d) + gap for d in docs])[:-1]
        end = len(codes) - gap - longest  # where the last document ends
        for a in range(gap, end, SLICE):
            own, minima, hashes = codes[a : a + SLICE + longest - 1], {}, {}
            for k in self.firsts:
                p = PARTS[k]
                if p.shingle not in hashes:
                    hashes[p.shingle] = shingles(own, p.shingle)
                    minima[p.shingle] = _Minima(_mix(hashes[p.shingle], _SEEDS[0]))
                first = minima[p.shingle].over(p.block - p.shingle + 1)[: min(SLICE, end - a)]
                at = np.flatnonzero(self._passes(self.firsts[k], first))
                for c in range(0, len(at), CLOSE):
                    near = at[c : c + CLOSE]
                    band = bands(own, k, near, first[near], hashes[p.shingle])
                    passed = self._passes(self.bands[k], band)
                    near, band = near[passed] + a, band[passed]
                    if not len(near):
                        continue
                    around, doc = _surroundings(codes, near, p), np.searchsorted(starts, near, "right") - 1
                    once = np.unique(np.column_stack([doc.astype(np.uint32), around]), axis=0, return_index=True)[1]
                    yield k, doc[once], band[once], around[once]


def _packed(blocks: DataFrame, column: str, bits: int) -> dict[int, np.ndarray]:
    """Of each partition the bits of the filter over ``column``, at most MOST_BITS in all 4 KB pieces together."""

    def place(values: pd.Series) -> pd.Series:
        return pd.Series(filter_bits(values.to_numpy(np.int64).view(np.uint64), bits))

    at = F.pandas_udf(place, "bigint")(column) + 1
    rows = blocks.select("part", at.alias("at")).groupBy("part", F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        whole = out.setdefault(r["part"], np.zeros(bits // 8, np.uint8))
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["piece"] - 1) * 4096
        whole[start : start + 4096] = piece[: len(whole) - start]
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, item_id, run) of the pairs of surroundings whose blocks agree and whose common stretch is long enough."""

    def matrix(texts: pd.Series) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), -1)

    for pdf in batches:
        for k, rows in pdf.groupby("part"):
            p = PARTS[k]
            same = matrix(rows["around"]) == matrix(rows["item_around"])
            right = np.cumprod(same[:, p.run :], axis=1, dtype=np.int32).sum(axis=1)
            left = np.cumprod(same[:, : p.run][:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
            held = (right >= p.block) & (left + right >= p.run)  # every shingle of the block in its place, and the stretch
            yield pd.DataFrame({"doc_id": rows["doc_id"][held].astype("Int64"), "item_id": rows["item_id"][held], "run": (left + right)[held]})


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run): every document that holds 60 or, of zh and ja items, 25 or more consecutive kept characters of an item.

    run is the length of the longest such stretch around one block, so at most
    two runs and a block. Texts are read in NFKC form and lower case, keeping
    letters, marks and digits. Null and empty texts and items shorter than a run
    are in no case; an item whose lang is null needs the longer run; empty tables
    give an empty result. Documents or items that share an id each count.
    """
    wide = F.coalesce(F.lower(F.trim("lang")).isin(*WIDE_LANGS), F.lit(False))
    rows = items.filter("item_id is not null and text is not null").select("item_id", wide.alias("wide"), "text")
    blocks = cut(rows.mapInPandas(_item_blocks, "part int, band bigint, first bigint, item_id bigint, around string").distinct())
    bits = 1 << 15
    count = blocks.count()
    while bits < min(FILTER_BITS * count, MOST_BITS):
        bits *= 2
    sent = documents.sparkSession.sparkContext.broadcast((_packed(blocks, "first", bits), _packed(blocks, "band", bits), bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve = Sieve(*sent.value)

        def passed(ids: list[int], docs: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            for k, doc, band, around in sieve.windows(docs):
                yield pd.DataFrame({"part": k, "band": band.view(np.int64), "doc_id": pd.array([ids[d] for d in doc], "Int64"), "around": _strings(around)})

        ids: list[int] = []
        docs: list[np.ndarray] = []
        held = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                if isinstance(text, str) and text:
                    ids.append(doc_id)
                    docs.append(kept_text(text))
                    held += len(docs[-1])
                    if held >= SLICE:
                        yield from passed(ids, docs)
                        ids, docs, held = [], [], 0
        if docs:
            yield from passed(ids, docs)

    windows = cut(documents.select("doc_id", "text").mapInPandas(run, "part int, band bigint, doc_id bigint, around string"))
    met = salted_join(windows, blocks.select("band", "item_id", F.col("around").alias("item_around")), "band")
    hits = met.select("part", "doc_id", "item_id", "around", "item_around").mapInPandas(_verify, "doc_id bigint, item_id bigint, run int")
    return hits.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents, longest_run) of every item, 0 documents where none holds it."""
    per = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("run").alias("longest_run"))
    return items.select("item_id", "suite").join(per, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
