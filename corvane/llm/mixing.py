"""Problem 8: sources mixed to target weights of a token budget.

Entropy balancing. Every document of a mix starts at one base rate, the mix's
budget over the tokens of all its sources, whatever its source. Of all rates up
to the cap that give each source its tokens, those nearest to the base rate in
relative entropy are the base rate exponentially tilted in the document's size.
The dual has one variable a source, all of a mix in one vector; it is concave, and
Newton steps climb it for all mixes at once. Gradient and Hessian of a step are
one aggregate over the size histogram of the documents, which is exact and far
smaller than they are. The rates are then rounded to copies by a number that the
document's id fixes, at the threshold that brings each source's tokens nearest to
what is wanted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# The word-and-punctuation pattern \w+|[^\w\s]+ with its Unicode classes spelled out.
WORD = r"\p{L}\p{N}_"
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = f"[{WORD}]+|[^{WORD}{BLANK}]+"

_TILTS = "mix_id int, source string, cap int, base double, tilt double"


def token_count(text: Column) -> Column:
    """Matches of the public word-and-punctuation pattern in ``text``; 0 of a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def source_name(c: Column) -> Column:
    plain = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(plain != "", plain)


def document_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of every document, copies too; source is null where it names none."""
    return documents.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def mix_wants(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, max_repeats, tokens, want, micro): want = all tokens x budget x target permille; micro is a million times that, exact.

    A source that no document has is there with 0 tokens. All documents count
    towards the total, also those without a source.
    """
    per = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("tokens"))
    total = histogram.agg(F.coalesce(F.sum(F.col("tokens") * F.col("docs")), F.lit(0))).first()[0]  # one number
    rows = targets.filter("mix_id is not null").withColumn("source", source_name(F.col("source"))).filter("source is not null")
    rows = rows.groupBy("mix_id", "source").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_permille", "max_repeats", "budget_permille")))
    rows = rows.join(per, "source", "left").withColumn("total", F.lit(total)).withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
    dec = lambda c, n: F.col(c).cast(f"decimal({n},0)")
    micro = dec("total", 18) * dec("budget_permille", 6) * dec("target_permille", 6)
    return rows.select("mix_id", "source", F.greatest("max_repeats", F.lit(0)).cast("int").alias("max_repeats"), "tokens", (micro / F.lit(1_000_000)).cast("double").alias("want"), micro.alias("micro"))


def _rate(tilt: Column, base: Column, size: Column, cap: Column) -> Column:
    """min(cap, base x exp(tilt x size)); an infinite tilt gives every document the cap."""
    # exp's argument is bounded by the cap's logarithm, above which the rate is the cap anyway
    tilted = F.least(cap.cast("double"), base * F.exp(F.least(F.lit(60.0), tilt * size)))
    return F.when(tilt == F.lit(math.inf), cap.cast("double")).otherwise(tilted)


class _Dual:
    """The dual variable of one source of a mix: Newton steps kept within the bracket that the signs of the gradient leave."""

    def __init__(self, want: float) -> None:
        self.want, self.tilt, self.low, self.high, self.steps, self.done = want, 0.0, -math.inf, math.inf, 0, False

    def step(self, given: float, slope: float, tolerance: float) -> None:
        """One step from the tokens ``given`` at the tilt and their derivative, the gradient's and the Hessian's part of this source."""
        miss = self.want - given
        if abs(miss) <= tolerance * self.want:
            self.done = True
            return
        self.low, self.high = (self.tilt, self.high) if miss > 0 else (self.low, self.tilt)
        # The tokens grow about exponentially in the tilt, so the step is taken on their logarithm.
        move = math.log(self.want / given) * given / slope if given > 0 and slope > 0 else math.inf if miss > 0 else -math.inf
        to = self.tilt + max(-16.0, min(16.0, move))
        if not self.low < to < self.high:
            to = (self.low + self.high) / 2
        self.tilt, self.steps = to, self.steps + 1


def solve_tilts(histogram: DataFrame, wants: DataFrame, max_steps: int = 100, tolerance: float = 1e-4) -> list[tuple[int, str, int, float, float, int]]:
    """[(mix_id, source, max_repeats, base, tilt, steps)] of every target row at the maximum of the dual.

    The rate of a document is min(max_repeats, base x exp(tilt x tokens / mean)).
    base is the mix's budget over the tokens of its sources, so no source meets its
    target before its tilt is found. A share that all copies together do not reach,
    or just reach, has its maximum at infinity: every document at the cap; one of 0
    at minus infinity, told as a base of 0. Not to have met the tolerance after
    ``max_steps`` is an error.
    """
    spark = histogram.sparkSession
    rows = wants.collect()  # one a target row
    budget: dict[int, list[float]] = {}
    for r in rows:
        b = budget.setdefault(r["mix_id"], [0.0, 0.0])
        b[0] += r["want"]
        b[1] += r["tokens"]
    base = {m: w / t if t else 0.0 for m, (w, t) in budget.items()}
    duals = {(r["mix_id"], r["source"]): _Dual(r["want"]) for r in rows}
    cap = {(r["mix_id"], r["source"]): r["max_repeats"] for r in rows}
    for r in rows:
        x = duals[r["mix_id"], r["source"]]
        if r["want"] <= 0:
            x.tilt, x.done = -math.inf, True
        elif r["want"] >= r["max_repeats"] * r["tokens"]:
            x.tilt, x.done = math.inf, True
    sizes = cut(
        histogram.filter("source is not null and tokens > 0").select("source", "tokens", "docs")
        .join(_means(histogram), "source").select("source", "tokens", "docs", (F.col("tokens") / F.col("mean")).alias("size"))
    )
    for _ in range(max_steps):
        open_ = [(m, s, cap[m, s], base[m], x.tilt) for (m, s), x in duals.items() if not x.done]
        if not open_:
            return [(m, s, cap[m, s], 0.0 if x.tilt == -math.inf else base[m], 0.0 if x.tilt == -math.inf else x.tilt, x.steps) for (m, s), x in duals.items()]
        at = F.broadcast(spark.createDataFrame(open_, _TILTS))  # at most one row a target row
        rate = _rate(F.col("tilt"), F.col("base"), F.col("size"), F.col("cap"))
        given = F.col("docs") * F.col("tokens") * F.col("rate")
        sums = sizes.join(at, "source").withColumn("rate", rate).groupBy("mix_id", "source").agg(
            F.sum(given).alias("given"), F.sum(F.when(F.col("rate") < F.col("cap"), given * F.col("size")).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():
            duals[r["mix_id"], r["source"]].step(r["given"], r["slope"], tolerance)
    raise RuntimeError(f"{len(open_)} shares not met within {max_steps} Newton steps")


def _means(histogram: DataFrame) -> DataFrame:
    """(source, mean) tokens of the documents of a source that have any."""
    some = histogram.filter("source is not null and tokens > 0")
    return some.groupBy("source").agg((F.sum(F.col("tokens") * F.col("docs")) / F.sum("docs")).alias("mean"))


#: A threshold is found in this many steps of 1, then in as many parts of the step it lies in.
STEPS = 1024


def _turns(drawn: DataFrame) -> DataFrame:
    """(mix_id, source, step, part, n): where a document gains a copy as the shift grows from -1 to 1, and the tokens it gains.

    ``drawn`` has x = rate + draw of each document; x + shift rounded down is its
    number of copies, so it gains one where the fraction passes a whole number.
    """
    whole, f = F.floor("x"), F.col("x") - F.floor("x")
    copies = lambda n: F.least(F.col("cap").cast("bigint"), F.greatest(n, F.lit(0)))
    gain = lambda at, to: F.struct((at + 1).alias("at"), ((copies(to) - copies(to - 1)) * F.col("tokens")).alias("n"))
    rows = drawn.select("mix_id", "source", F.explode(F.array(gain(-f, whole), gain(1 - f, whole + 1))).alias("g")).filter("g.n > 0")
    step = F.floor(F.col("g.at") * STEPS).cast("int")
    return rows.select("mix_id", "source", step.alias("step"), F.floor((F.col("g.at") * STEPS - step) * STEPS).cast("int").alias("part"), "g.n")


def _gains(turns: DataFrame, place: str) -> dict[tuple[int, str], list[tuple[int, int]]]:
    """Of each source the (place, tokens gained there) in order, at most 2 x STEPS of them."""
    out: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for r in turns.groupBy("mix_id", "source", place).agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["mix_id"], r["source"]), []).append((r[place], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def _thresholds(drawn: DataFrame, wants: dict[tuple[int, str], float]) -> list[tuple[int, str, float]]:
    """[(mix_id, source, shift)] that bring the rounded tokens nearest to what is wanted.

    Two aggregates find the shift to 1 / STEPS squared, whatever the size of the
    source: the tokens gained in each step, then in each part of the step in which
    the wanted tokens are passed.
    """
    lowest = F.greatest(F.least(F.col("cap").cast("bigint"), F.floor("x") - 1), F.lit(0)) * F.col("tokens")
    before = {(r["mix_id"], r["source"]): r["n"] for r in drawn.groupBy("mix_id", "source").agg(F.sum(lowest).alias("n")).collect()}
    chosen = dict.fromkeys(before, 0)
    turns = _turns(drawn)
    for key, gains in _gains(turns, "step").items():
        for step, n in gains:
            chosen[key] = step
            if before[key] + n >= wants[key] or step == gains[-1][0]:
                break
            before[key] += n
    at = F.broadcast(drawn.sparkSession.createDataFrame([(*k, p) for k, p in chosen.items()], "mix_id int, source string, step int"))
    parts, out = _gains(turns.join(at, ["mix_id", "source", "step"]), "part"), []
    for key, step in chosen.items():
        got, best = before[key], (abs(before[key] - wants[key]), 0)
        for part, n in parts.get(key, []):
            got += n
            best = min(best, (abs(got - wants[key]), part + 1))
        out.append((*key, (step + best[1] / STEPS) / STEPS - 1))
    return out


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: (mix_id, doc_id, source, tokens, copies), the documents taken at least
    once, none more than max_repeats times. report: (mix_id, source, want_tokens,
    got_tokens, target_permille_of_mix, got_permille_of_mix, short, tilt, steps),
    got_tokens being counted from the copies. A source is short if the solution
    uses all of its documents max_repeats times and they still give fewer tokens
    than its share. Documents without a source or without tokens are in no mix;
    null and empty texts have no tokens; empty tables give an empty result. The
    draw of a document depends on mix, id and seed only; documents that share an
    id are drawn alike.
    """
    spark = documents.sparkSession
    docs = cut(document_sizes(documents))
    histogram = cut(docs.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")))
    wants = cut(mix_wants(histogram, targets))
    tilts = solve_tilts(histogram, wants)
    # one row a target row, so bounded by the caller's table
    at = spark.createDataFrame(tilts, _TILTS + ", steps int")
    rate = _rate(F.col("tilt"), F.col("base"), F.col("tokens") / F.col("mean"), F.col("cap"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.filter("tokens > 0").join(F.broadcast(at.join(_means(histogram), "source")), "source")
    drawn = drawn.withColumn("x", F.when(F.col("base") > 0, rate + draw).otherwise(0.0)).select("mix_id", "source", "doc_id", "tokens", "cap", "tilt", "x")
    open_ = drawn.filter((F.col("tilt") != F.lit(math.inf)) & (F.col("x") > 0))
    shifts = _thresholds(open_, {(r["mix_id"], r["source"]): r["want"] for r in wants.collect()})
    shift = F.broadcast(spark.createDataFrame(shifts, "mix_id int, source string, shift double"))
    rounded = F.when(F.col("tilt") == F.lit(math.inf), F.col("cap")).when(F.col("x") > 0, F.floor(F.col("x") + F.coalesce("shift", F.lit(0.0))))
    copies = (
        drawn.join(shift, ["mix_id", "source"], "left").withColumn("copies", F.greatest(F.lit(0), F.least(F.col("cap"), rounded)).cast("int"))
        .filter("copies > 0").select("mix_id", "doc_id", "source", "tokens", "copies")
    )
    got = copies.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got_tokens"))
    report = wants.join(got, ["mix_id", "source"], "left").withColumn("got_tokens", F.coalesce("got_tokens", F.lit(0)).cast("bigint"))
    report = report.join(F.broadcast(at.select("mix_id", "source", "tilt", "steps")), ["mix_id", "source"])
    sums = report.groupBy("mix_id").agg(F.sum("want").alias("all_want"), F.sum("got_tokens").alias("all_got"))
    share = lambda c, of: F.round(1000 * F.col(c) / F.nullif(F.col(of), F.lit(0)), 2)
    used_up = F.col("got_tokens") == F.col("max_repeats") * F.col("tokens")
    short = used_up & (F.col("got_tokens").cast("decimal(20,0)") * F.lit(1_000_000) < F.col("micro"))
    report = report.join(sums, "mix_id").select(
        "mix_id", "source", F.round("want").cast("bigint").alias("want_tokens"), "got_tokens",
        share("want", "all_want").alias("target_permille_of_mix"), share("got_tokens", "all_got").alias("got_permille_of_mix"), short.alias("short"), "tilt", "steps",
    )
    return copies, report
