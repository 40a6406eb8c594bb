"""Problem 3: pairwise matches consolidated into groups.

The graph is reduced before it is solved: vertices of degree one are stripped,
vertices of degree two are taken out of their chains by list ranking (each round
takes an independent set of them, the local maxima of a hash), both again and
again; whatever core is left, without vertices of degree one or two, is solved
by star contraction; then the removed vertices take the label of the vertex they
hung on, the last round first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..session import cut
from ..skew import lookup_join


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )


def _degrees(edges: DataFrame) -> DataFrame:
    """Of each vertex its degree and its least and greatest neighbour; aggregated before the shuffle."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy(F.col("u").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _replace(edges: DataFrame, gone: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """``edges`` without ``gone`` and with ``new``, in one shuffle on the pair, which is never a hot key."""
    tagged = edges.withColumn("gone", F.lit(0)).unionByName(
        gone.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1).alias("gone"))
    )
    if new is not None:
        tagged = tagged.unionByName(new.select("u", "v", F.lit(0).alias("gone")))
    return tagged.groupBy("u", "v").agg(F.max("gone").alias("gone")).filter("gone = 0").select("u", "v")


def strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, removed (vertex, parent)): every vertex of degree one, of a lone pair the greater."""
    leaves = _degrees(edges).filter("degree = 1").select("vertex", F.col("lo").alias("parent"))
    # Of a lone pair both ends are leaves: the pair appears twice here, once from each end.
    removed = cut(
        leaves.groupBy(F.least("vertex", "parent").alias("u"), F.greatest("vertex", "parent").alias("v"))
        .agg(F.max("vertex").alias("vertex"))
        .select("vertex", F.when(F.col("vertex") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent"))
    )
    return cut(_replace(edges, removed.select(F.col("vertex").alias("u"), F.col("parent").alias("v")))), removed


def compress_chains(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges left, removed (vertex, parent)): vertices of degree two whose hash exceeds those of both neighbours.

    No two of them are neighbours, so all can be bridged at once; a third of a
    long chain goes in each round, whatever the order of its ids.
    """
    rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    before = lambda c: (rank("vertex") > rank(c)) | ((rank("vertex") == rank(c)) & (F.col("vertex") > F.col(c)))
    inner = cut(_degrees(edges).filter("degree = 2").filter(before("lo") & before("hi")).select("vertex", "lo", "hi"))
    gone = inner.select(F.col("vertex").alias("u"), F.explode(F.array("lo", "hi")).alias("v"))
    left = _replace(edges, gone, inner.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    return cut(left), inner.select("vertex", F.col("lo").alias("parent"))


def _climb(forest: DataFrame, rows: int, depth: int) -> DataFrame:
    """(vertex, parent) with parent replaced by the topmost ancestor, by pointer doubling."""
    for _ in range(max(1, depth).bit_length()):
        above = forest.select(F.col("vertex").alias("parent"), F.col("parent").alias("above"))
        forest = cut(lookup_join(forest, above, "parent", rows=rows).select("vertex", F.coalesce("above", "parent").alias("parent")))
    return forest


def _attach(labels: DataFrame | None, removed: DataFrame, rows: int) -> DataFrame:
    """``labels`` with those of ``removed`` (vertex, parent); a parent without one is the root of its component."""
    if labels is None:
        found = removed.select("vertex", F.col("parent").alias("root"))
        return cut(found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct()))
    known = labels.select(F.col("vertex").alias("parent"), "root")
    found = cut(lookup_join(removed, known, "parent", rows=rows).select("vertex", "parent", F.col("root").alias("known")))
    roots = found.filter("known is null").select(F.col("parent").alias("vertex"), F.col("parent").alias("root")).distinct()
    return cut(reduce(DataFrame.unionByName, [labels, found.select("vertex", F.coalesce("known", "parent").alias("root")), roots]))


def reduced_components(edges: DataFrame, max_rounds: int = 200, small_step: float = 0.1) -> DataFrame:
    """(vertex, root) of every vertex in ``edges`` (u, v), equal roots for vertices linked directly or not.

    Vertices may be of any orderable type. Null and self links relate nothing
    and repeated or reversed links count once; vertices without a link do not
    come out. ``root`` is one vertex of the component, not always the smallest.
    Rounds go on while they remove more than ``small_step`` of the edges that are
    left, with 0 until nothing is left to strip; star contraction solves the rest
    as the core, so the bound decides how the work is divided, never the result.
    More than ``max_rounds`` rounds are an error.
    """
    left = cut(_canonical(edges))
    total = n = left.count()
    first, later, later_rows, rounds = None, [], 0, 0
    while n:
        if rounds == max_rounds:
            raise RuntimeError(f"leaves or chains left after {max_rounds} rounds")
        left, leaves = strip_leaves(left)
        if first is None:
            first = leaves
            later_rows = left.count()
            if not later_rows:
                n = 0
                break
        else:
            later.append(leaves)
        left, inner = compress_chains(left, rounds)
        later.append(inner)
        was, n, rounds = n, left.count(), rounds + 1
        if was - n <= small_step * was:
            break
    if first is None:
        return left.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    labels = star_components(left).select("vertex", "root") if n else None
    if later:
        # Every vertex removed after the first strip had an edge then, and each removal took one edge.
        labels = _attach(labels, _climb(cut(reduce(DataFrame.unionByName, later)), later_rows, 2 * rounds), later_rows)
    return _attach(labels, first, total)


def match_links(matches: DataFrame, records: DataFrame, max_distance: int) -> DataFrame:
    """(u, v) of the matches that hold: both ids known and different, and the kind's own condition.

    A null distance is computed from the two hashes; with a hash missing the pair is no link.
    """
    known = records.select("record_id", "phash")
    pairs = (
        matches.filter("left_record_id <> right_record_id")
        .filter((F.col("match_kind") == "sha256") | ((F.col("match_kind") == "phash") & (F.coalesce("phash_distance", F.lit(0)) <= max_distance)))
        .select("left_record_id", "right_record_id", "match_kind", "phash_distance").distinct()
    )
    pairs = lookup_join(pairs, known.toDF("left_record_id", "left_hash"), "left_record_id", "inner")
    pairs = lookup_join(pairs, known.toDF("right_record_id", "right_hash"), "right_record_id", "inner")
    differing = F.bit_count(F.col("left_hash").bitwiseXOR(F.col("right_hash")))
    near = F.coalesce(F.col("phash_distance"), differing) <= max_distance
    return pairs.filter((F.col("match_kind") == "sha256") | near).select(F.col("left_record_id").alias("u"), F.col("right_record_id").alias("v"))


def consolidate_matches(audit: DataFrame, matches: DataFrame, max_distance: int = 2) -> DataFrame:
    """(group_root, record_id, group_size): one row for each record of the audit.

    Links are the matches that hold (see ``match_links``) and equal non-null
    group_id values within one dataset_id; group_root is the smallest record_id
    of the group, of a record without links its own id with group_size 1. Rows
    with a null record_id are left out; re-delivered rows count once, and a null
    dataset_id relates nothing. Empty tables give an empty result; other columns
    do not matter.
    """
    rows = audit.filter("record_id is not null")
    records = cut(
        rows.groupBy("record_id").agg(
            F.max("phash").alias("phash"),
            F.max(F.when(F.col("dataset_id").isNotNull() & F.col("group_id").isNotNull(), F.concat_ws("\u0000", "dataset_id", "group_id"))).alias("hub"),
        )
    )
    keyed = records.filter("hub is not null")
    first = keyed.groupBy("hub").agg(F.min("record_id").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub", "v")
    stars = lookup_join(keyed.select("hub", F.col("record_id").alias("u")), first, "hub", "inner").select("u", "v")
    labels = reduced_components(stars.unionByName(match_links(matches, records, max_distance)))
    roots = labels.groupBy("root").agg(F.min("vertex").alias("group_root"), F.count(F.lit(1)).alias("group_size"))
    grouped = lookup_join(labels, roots, "root", "inner").select("group_root", F.col("vertex").alias("record_id"), "group_size")
    alone = records.select("record_id").join(labels.select(F.col("vertex").alias("record_id")), "record_id", "left_anti")
    return grouped.unionByName(alone.select(F.col("record_id").alias("group_root"), "record_id", F.lit(1).cast("bigint").alias("group_size")))
