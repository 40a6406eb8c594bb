"""Problem 1: train, validation and test splits that keep related records together.

Records are related by shared keys; the related sets are the components of the
graph of keys. Whole components are then assigned: from a hashed start, moves of
one component and exchanges of two are tried by simulated annealing in parallel
chains, and the best state seen is kept. Components that hold a large part of
the rows are placed first, over all of them at once; the others in blocks, each
chain of a block being a task of its own. After a sweep the components are dealt
into other blocks, which then take their part of the deviation left over all, so
that components of different blocks change places too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_values, cut
from ..skew import lookup_join
from .groups import reduced_components

#: A component with 1/LARGE of all records or more is placed first: at most LARGE of them.
LARGE = 512
#: Components a block holds on average, and sweeps over all blocks.
BLOCK, SWEEPS = 4096, 3
#: Label classes, each with its own deviation; more are refused, never lumped together.
MOST_LABELS = 512
UNKNOWN_GROUPS = ("", "unknown", "none", "n-a")


def video_key(c: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends; null where it names nothing."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(~plain.isin(*UNKNOWN_GROUPS), plain)


def split_name(c: Column) -> Column:
    plain = F.lower(F.trim(c))
    return F.when(plain == "valid", "val").when(plain != "", plain)


def related_records(audit: DataFrame) -> DataFrame:
    """(record_id, component, source_split, labels) with one row for each non-null record_id.

    Records sharing a video (see ``video_key``) or a group_id within a dataset_id
    get one component, directly or through others; a record with neither is alone.
    Re-delivered rows count once; labels are the class ids of the boxes.
    """
    videos = F.concat(F.lit("v:"), video_key(F.col("source_video_group")))
    groups = F.when(F.col("dataset_id").isNotNull() & F.col("group_id").isNotNull(), F.concat(F.lit("g:"), "dataset_id", F.lit("\u0000"), "group_id"))
    labels = F.array_sort(F.filter(F.transform("boxes", lambda b: b["class_id"]), lambda c: c.isNotNull()))
    rows = audit.filter("record_id is not null").select(
        "record_id", videos.alias("v"), groups.alias("u"), split_name(F.col("source_split")).alias("source_split"),
        F.coalesce(labels, F.array().cast("array<int>")).alias("labels"),
    )
    records = cut(rows.groupBy("record_id").agg(*(F.max(c).alias(c) for c in ("v", "u", "source_split", "labels"))))
    roots = reduced_components(records.select("u", "v"))
    keyed = records.withColumn("vertex", F.coalesce("v", "u"))
    found = lookup_join(keyed.filter("vertex is not null"), roots, "vertex")
    own = F.concat(F.lit("r:"), F.col("record_id").cast("string"))
    cols = ["record_id", "component", "source_split", "labels"]
    return cut(
        found.withColumn("component", F.coalesce("root", "vertex")).select(*cols)
        .unionByName(keyed.filter("vertex is null").withColumn("component", own).select(*cols))
    )


def _anneal(sizes: np.ndarray, aims: np.ndarray, start: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Best (cost, split of each row) of one chain. sizes: rows x measures; aims: splits x measures."""
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(aims)
    weight = 1.0 / np.maximum(sizes.sum(axis=0), 1.0) ** 2
    weight[1:] /= max(1, len(weight) - 1)
    at = start.copy()
    off = np.zeros_like(aims)
    np.add.at(off, at, sizes)
    off -= aims
    cost = float((off**2 * weight).sum())
    best, kept = cost, at.copy()
    picks, others = rng.integers(0, n, (2, steps))
    turns, chances = rng.integers(1, max(2, k), steps), rng.random(steps)
    heat = max(cost, 1e-6) * 0.1
    for t in range(steps):
        if k < 2 or cost < 1e-12:
            break
        i, j = picks[t], others[t]
        a = at[i]
        exchange = t % 2 and at[j] != a
        b = at[j] if exchange else (a + turns[t]) % k
        moved = sizes[i] - sizes[j] if exchange else sizes[i]
        to_a, to_b = off[a] - moved, off[b] + moved
        change = float(((to_a**2 + to_b**2 - off[a] ** 2 - off[b] ** 2) * weight).sum())
        if change <= 0 or chances[t] < math.exp(-change / (heat * (1 - t / steps) ** 2 + 1e-300)):
            off[a], off[b] = to_a, to_b
            at[i] = b
            if exchange:
                at[j] = a
            cost += change
            if cost < best - 1e-15:
                best, kept = cost, at.copy()
    return best, kept


def _whole_parts(parts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``parts`` (splits x measures) in whole numbers with the same sums, each rounded up or down at random by what it lacks.

    Were every block to aim at a tenth of a rare label, none would give it away;
    so one block in ten aims at a whole one.
    """
    ends = np.cumsum(parts, axis=0)
    ends[-1] = np.rint(ends[-1])
    draw = rng.random(parts.shape[1])
    return np.diff(np.floor(ends + draw + 1e-9), axis=0, prepend=np.floor(draw + 1e-9)[None, :])


def _hashed(share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The split in which each uniform draw falls."""
    return np.minimum(np.searchsorted(np.cumsum(share), draws, side="right"), len(share) - 1)


def group_safe_splits(audit: DataFrame, targets: DataFrame, chains: int = 2, seed: int = 11) -> DataFrame:
    """(record_id, component, crosses, splits): one row a record, splits being [(plan_id, split)].

    All records of a component get one split in each plan of ``targets``
    (plan_id, split, target_permille), with record and label shares near the
    plan's. ``crosses`` tells whether the component's records already lie in more
    than one source_split, ``valid`` read as ``val``, null as none. Plans are the
    caller's few; the rows of a plan with a null or no positive target take no
    part. A component larger than its split's target is still not cut. Empty
    tables give an empty result; a plan table without rows gives empty ``splits``.
    """
    spark = audit.sparkSession
    records = related_records(audit)
    classes = bounded_values(records.select(F.explode("labels").alias("label")), "label", MOST_LABELS)
    of = lambda c: F.sum(F.size("labels") - F.size(F.array_remove("labels", c)))
    counts = [of(c).alias(f"m{i}") for i, c in enumerate(classes, 1)]
    names = [f"m{i}" for i in range(len(classes) + 1)]
    sets = cut(
        records.groupBy("component").agg(
            F.count(F.lit(1)).alias("m0"), *counts, (F.min("source_split") < F.max("source_split")).alias("crosses")
        ).withColumn("crosses", F.coalesce("crosses", F.lit(False)))
    )
    sums = sets.agg(F.count(F.lit(1)), *(F.sum(c) for c in names)).first()
    n_sets, total = sums[0], np.array([float(x or 0) for x in sums[1:]])
    plans: dict[int, list[tuple[str, float]]] = {}
    for r in targets.filter("plan_id is not null and split is not null and target_permille > 0").orderBy("plan_id", F.desc("target_permille"), "split").collect():
        plans.setdefault(r["plan_id"], []).append((r["split"], float(r["target_permille"])))
    plans = {p: [(s, x / sum(y for _, y in v)) for s, x in v] for p, v in plans.items()}
    least = total[0] / LARGE
    # each component's own uniform numbers, the same wherever it is computed
    draw = [((F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "component"), F.lit(1 << 30)) / F.lit(float(1 << 30)))).alias(f"u{p}") for p in plans]
    large = sets.filter(F.col("m0") >= least).select("component", *names, *draw).orderBy("component").toPandas() if plans else None
    placed: dict[int, np.ndarray] = {}
    fixed: list[tuple[str, int, str]] = []
    if plans and len(large):
        sizes, draws = large[names].to_numpy(float), {p: large[f"u{p}"].to_numpy() for p in plans}
        tries = [(p, c) for p in plans for c in range(4 * chains)]

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k in pdf["id"]:
                    p, c = tries[k]
                    share = np.array([s for _, s in plans[p]])
                    start = _hashed(share, draws[p])
                    cost, at = _anneal(sizes, np.outer(share, total) * (sizes.sum(axis=0) / np.maximum(total, 1)), start, seed + c, 20_000)
                    yield pd.DataFrame({"k": [k], "cost": [cost], "at": [at.tolist()]})

        ran = spark.range(len(tries)).repartition(len(tries)).mapInPandas(chain, "k long, cost double, at array<int>").collect()
        for p, splits in plans.items():
            at = np.array(min((r for r in ran if tries[r["k"]][0] == p), key=lambda r: (r["cost"], r["k"]))["at"])
            placed[p] = np.zeros((len(splits), len(names)))
            np.add.at(placed[p], at, sizes)
            fixed += [(c, p, splits[s][0]) for c, s in zip(large["component"], at)]
    answer = sets.select("component", "crosses")
    if plans:
        small = sets.filter(F.col("m0") < least).select("component", *names, *draw)
        wanted = {p: np.outer([x for _, x in splits], total) - placed.get(p, 0) for p, splits in plans.items()}
        chosen = _swept(small, names, wanted, plans, chains, seed)
        named = F.element_at(F.array(*(F.array(*(F.lit(s) for s, _ in plans[p])) for p in plans)), F.array_position(F.array(*map(F.lit, plans)), F.col("plan_id")).cast("int"))
        chosen = chosen.select("component", "plan_id", F.element_at(named, F.col("at") + 1).alias("split"))
        if fixed:
            chosen = chosen.unionByName(spark.createDataFrame(fixed, "component string, plan_id int, split string"))
        packed = chosen.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("plan_id", "split"))).alias("splits"))
        answer = answer.join(packed, "component", "left")
    else:
        answer = answer.withColumn("splits", F.array().cast("array<struct<plan_id:int,split:string>>"))
    return lookup_join(records.select("record_id", "component"), cut(answer), "component", "inner").select("record_id", "component", "crosses", "splits")


def _swept(small: DataFrame, names: list[str], wanted: dict[int, np.ndarray], plans: dict[int, list[tuple[str, float]]], chains: int, seed: int) -> DataFrame:
    """(component, plan_id, at): the split of each component of ``small`` in each plan, by number.

    ``wanted`` has for each plan what its splits should hold of each measure in
    ``names``. A block's chains are compared where the blocks are; what leaves the
    executors is one sum for each plan, split and measure.
    """
    blocks = max(1, math.ceil(small.count() / BLOCK))
    state = small.withColumn("now", F.lit(None).cast("map<int,int>"))
    off = {p: np.zeros_like(w) for p, w in wanted.items()}

    def run(pdf: pd.DataFrame, off: dict[int, np.ndarray], sweep: int) -> pd.DataFrame:
        pdf = pdf.sort_values("component", ignore_index=True)
        p, chain, block = (int(pdf[c][0]) for c in ("plan_id", "chain", "block"))
        sizes, rng = pdf[names].to_numpy(float), np.random.default_rng([seed, p, block, sweep])
        if sweep:
            start = np.array([dict(x)[p] for x in pdf["now"]])
            aims = np.zeros_like(wanted[p])
            np.add.at(aims, start, sizes)
            aims -= _whole_parts(off[p] / blocks, rng)  # this block's part of what is too much or too little over all
        else:
            share = np.maximum(wanted[p], 0) / np.maximum(np.maximum(wanted[p], 0).sum(axis=0), 1e-9)
            start = _hashed(share[:, 0] if share[:, 0].sum() > 0 else np.array([x for _, x in plans[p]]), pdf[f"u{p}"].to_numpy())
            aims = _whole_parts(share * sizes.sum(axis=0), rng)
        cost, at = _anneal(sizes, aims, start, seed + 7919 * block + 31 * sweep + chain, 4000 + 2 * len(sizes))
        return pd.DataFrame({"block": [block], "plan_id": [p], "chain": [chain], "cost": [cost], "components": [pdf["component"].tolist()], "at": [at.tolist()]})

    def run_with(off: dict[int, np.ndarray], sweep: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: run(pdf, off, sweep)

    tasks = F.explode(F.array(*(F.struct(F.lit(p).alias("plan_id"), F.lit(c).alias("chain")) for p in plans for c in range(chains)))).alias("t")
    for sweep in range(SWEEPS if blocks > 1 else 1):
        dealt = state.withColumn("block", F.pmod(F.xxhash64(F.lit(f"block {sweep}"), "component"), F.lit(blocks)).cast("int"))
        tried = dealt.select("*", tasks).select(*dealt.columns, "t.*").groupBy("block", "plan_id", "chain").applyInPandas(
            run_with(off, sweep), "block int, plan_id int, chain int, cost double, components array<string>, at array<int>"
        )
        best = tried.groupBy("block", "plan_id").agg(F.min_by(F.struct("components", "at"), F.struct("cost", "chain")).alias("b"))
        chosen = cut(best.select("plan_id", F.explode(F.arrays_zip("b.components", "b.at")).alias("x")).select("plan_id", F.col("x.components").alias("component"), "x.at"))
        if sweep + 1 < SWEEPS and blocks > 1:
            now = chosen.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("plan_id", "at"))).alias("now"))
            state = cut(small.join(now, "component"))
            sums = state.select(F.explode("now").alias("plan_id", "at"), *names).groupBy("plan_id", "at").agg(*(F.sum(c).alias(c) for c in names))
            off = {p: -w for p, w in wanted.items()}
            for r in sums.collect():
                off[r["plan_id"]][r["at"]] += np.array([float(r[c]) for c in names])
    return chosen.select("component", "plan_id", "at")


def split_report(assigned: DataFrame, audit: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, split, records, share_permille, target_permille, label_deviation_permille, worst_label_permille): what was reached beside what was asked for.

    The label deviations are of the split's share of the boxes of each class from
    the plan's share: the mean over all classes, and the greatest.
    """
    cols = ["plan_id", "split"]
    split = assigned.select("record_id", F.explode("splits").alias("s")).select("record_id", "s.*")
    rows = split.groupBy(*cols).agg(F.count(F.lit(1)).alias("records"))
    plans = targets.filter("plan_id is not null and split is not null and target_permille > 0").groupBy(*cols).agg(F.max("target_permille").alias("target_permille"))
    plans = plans.join(plans.groupBy("plan_id").agg(F.sum("target_permille").alias("whole")), "plan_id")
    totals = rows.groupBy("plan_id").agg(F.sum("records").alias("all"))
    labels = audit.filter("record_id is not null").groupBy("record_id").agg(F.max(F.array_sort(F.filter(F.transform("boxes", lambda b: b["class_id"]), lambda c: c.isNotNull()))).alias("labels"))
    boxes = split.join(labels, "record_id").select(*cols, F.explode("labels").alias("label")).groupBy(*cols, "label").agg(F.count(F.lit(1)).alias("n"))
    classes = boxes.groupBy("plan_id", "label").agg(F.sum("n").alias("of"))
    # a row for each split and class of a plan, also where the split has none of the class
    every = plans.select(*cols, "target_permille", "whole").join(F.broadcast(classes), "plan_id").join(boxes, [*cols, "label"], "left")
    apart = F.abs(F.coalesce("n", F.lit(0)) / F.col("of") - F.col("target_permille") / F.col("whole")) * 1000
    labelled = every.groupBy(*cols).agg(F.round(F.avg(apart), 2).alias("label_deviation_permille"), F.round(F.max(apart), 2).alias("worst_label_permille"))
    found = plans.join(rows, cols, "left").join(totals, "plan_id", "left").join(labelled, cols, "left")
    return found.select(
        *cols, F.coalesce("records", F.lit(0)).alias("records"), F.round(1000 * F.coalesce("records", F.lit(0)) / F.col("all"), 2).alias("share_permille"), "target_permille",
        "label_deviation_permille", "worst_label_permille",
    )
