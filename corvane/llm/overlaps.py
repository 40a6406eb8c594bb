"""Problem 4: the same or nearly the same image on both sides of a split.

A weighted cosine join, one vector an image. Its terms are the content digest,
weighing sqrt(DIGEST), and the 64 bits of the perceptual hash as +1 or -1; so the
dot product of two images is DIGEST if their digests agree plus 64 - 2 x (bits
that differ), and the bound ``least``, 64 - 2 x the distance allowed, is reached
if and only if one of the two criteria holds: DIGEST outweighs the bits even where
all of them differ. A missing digest or hash is a vector without those terms.

Inverted lists hold the images, as their distinct hashes and contents, by term.

* Maximum weight. A list of the digest reaches the bound by itself. A list of one
  block of bits does not: what two images that agree there can reach at most, all
  other blocks differing by a bit or more, stays below ``least``. The lists that can
  reach it are those of ``equal`` blocks together (``block_plan``), and only they are
  opened. Their number of bits widens with the number of hashes, so that the lists
  keep their length as the data grow.
* Residual norms. A posting carries the norms of the parts of its vector: how many
  bits are set in each quarter. The dot product over a quarter is at most its width
  less twice the difference of the two norms; pairs whose parts cannot sum to
  ``least`` are dropped before their dot product is formed.
* The exact dot product decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import Blocks, block_lists, block_plan, first_equal
from ..session import cut
from ..skew import lookup_join, salted_join

BITS = 64
#: Squared weight of the digest: above the bound even if all bits differ, and the same for every distance allowed.
DIGEST = 3 * BITS
QUARTERS = 4


def least(max_distance: int) -> int:
    """The dot product of two images whose hashes differ in ``max_distance`` bits and whose digests do not agree."""
    return BITS - 2 * max_distance


def dot_product(g: Column, h: Column) -> Column:
    """Exact dot product of the bits of two hashes as +1 and -1."""
    return BITS - 2 * F.bit_count(g.bitwiseXOR(h))


def _norms(h: Column) -> list[Column]:
    width = BITS // QUARTERS
    return [F.bit_count(F.shiftrightunsigned(h, q * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))) for q in range(QUARTERS)]


def reachable(max_distance: int) -> Column:
    """Whether the residual norms g0.. and h0.. let the dot product reach the bound."""
    apart = sum((F.abs(F.col(f"g{q}") - F.col(f"h{q}")) for q in range(QUARTERS)), F.lit(0))
    return BITS - 2 * apart >= least(max_distance)


def candidates(left: DataFrame, right: DataFrame, plan: Blocks) -> DataFrame:
    """Pairs (g, h) that meet in a list, with their residual norms; ``left`` and ``right`` hold distinct hashes g and h."""
    side = lambda df, c: block_lists(df.select(c, *(n.alias(f"{c}{q}") for q, n in enumerate(_norms(F.col(c))))), c, plan)
    return salted_join(side(left, "g"), side(right, "h").drop("chosen", "upto"), "key").filter(first_equal(F.col("g"), F.col("h"), plan))


def near_hashes(left: DataFrame, right: DataFrame, max_distance: int) -> DataFrame:
    """(left_phash, right_phash) of the distinct hashes (phash) of both sides that differ in at most ``max_distance`` bits."""
    one = lambda df, c: cut(df.filter("phash is not null").select(F.col("phash").alias(c)).distinct())
    a, b = one(left, "g"), one(right, "h")
    plan = block_plan(max(a.count(), b.count()), max_distance, BITS)
    pairs = candidates(a, b, plan).filter(reachable(max_distance)).filter(dot_product(F.col("g"), F.col("h")) >= least(max_distance))
    return pairs.select(F.col("g").alias("left_phash"), F.col("h").alias("right_phash"))


def latest_scans(scans: DataFrame) -> DataFrame:
    """(image_id, split, source, sha256, phash): of each image its row with the greatest scanned_at.

    split is lower case without outer blanks, source without outer blanks,
    sha256 the 64 hex digits in lower case, null where there are not 64; images
    without an id or without a split do not come out.
    """
    slim = scans.select(F.col("images.image_id").alias("image_id"), "scanned_at", F.col("images.split").alias("split"), "sha256", "phash", "source")
    last = slim.filter("image_id is not null").groupBy("image_id").agg(F.max(F.struct("scanned_at", "split", "sha256", "phash", "source")).alias("r")).select("image_id", "r.*")
    digits = F.regexp_extract(F.lower(F.trim("sha256")), "^(?:sha256:)?([0-9a-f]{64})$", 1)
    return last.select(
        "image_id", F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split"), F.trim("source").alias("source"),
        F.when(digits != "", digits).alias("sha256"), "phash",
    ).filter("split is not null")


def _contents(images: DataFrame, *also: str) -> DataFrame:
    """Classes of images alike in digest and hash (and ``also``), with their number n."""
    return images.groupBy("sha256", "phash", *also).agg(F.count(F.lit(1)).alias("n"))


def _sides(scans: DataFrame, train: str, evaluation: tuple[str, ...], max_distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = cut(latest_scans(scans))
    one, other = images.filter(F.col("split") == train), images.filter(F.col("split").isin(*evaluation))
    return one, other, cut(near_hashes(one, other, max_distance))


def cross_split_overlaps(
    scans: DataFrame, train: str = "train2017", evaluation: tuple[str, ...] = ("val2017", "test2017"), max_distance: int = 5
) -> DataFrame:
    """(train_image_id, image_id, split, source, same_content, near): one row a pair of a train and an evaluation image.

    A pair has equal sha256 or phash values that differ in at most
    ``max_distance`` bits; split and source are those of the evaluation image. A
    null sha256 or phash only leaves out its own comparison. Empty tables give an
    empty result. Classes of equal digests and of equal hashes are compared once
    and expanded at the end, where hot classes are spread over many tasks.
    """
    one, other, pairs = _sides(scans, train, evaluation, max_distance)
    a = one.select(F.col("image_id").alias("train_image_id"), "sha256", F.col("phash").alias("left_phash"))
    b = other.select("image_id", "split", "source", "sha256", F.col("phash").alias("right_phash"))
    cols = ["train_image_id", "image_id", "split", "source"]
    same = salted_join(a.filter("sha256 is not null").select("train_image_id", "sha256"), b.filter("sha256 is not null").drop("right_phash"), "sha256")
    near = salted_join(a.filter("left_phash is not null").select("train_image_id", "left_phash"), pairs, "left_phash")
    near = salted_join(near.select("train_image_id", "right_phash"), b.drop("sha256"), "right_phash")
    both = same.select(*cols, F.lit(True).alias("same_content"), F.lit(False).alias("near")).unionByName(
        near.select(*cols, F.lit(False).alias("same_content"), F.lit(True).alias("near"))
    )
    return both.groupBy(*cols).agg(F.max("same_content").alias("same_content"), F.max("near").alias("near"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """(split, source, images, pairs, same_content_pairs) of listed pairs; where they need no listing, ``overlap_counts`` gives the same."""
    per = pairs.groupBy("split", "source", "image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same_content").alias("same"))
    return per.groupBy("split", "source").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("pairs"), F.sum("same").alias("same_content_pairs"))


def overlap_counts(
    scans: DataFrame, train: str = "train2017", evaluation: tuple[str, ...] = ("val2017", "test2017"), max_distance: int = 5
) -> DataFrame:
    """(split, source, images, pairs, same_content_pairs) of the evaluation images that occur in train; source may be null.

    Pairs are counted from classes and never listed: those of equal content, plus
    those of near hashes, less those that are both.
    """
    one, other, pairs = _sides(scans, train, evaluation, max_distance)
    a, b = cut(_contents(one)), cut(_contents(other, "split", "source"))
    by = ["split", "source"]
    of_sha = a.filter("sha256 is not null").groupBy("sha256").agg(F.sum("n").alias("m"))
    same = lookup_join(b.filter("sha256 is not null"), of_sha, "sha256", "inner").select("sha256", "phash", *by, "n", "m")
    # how many train images are near a hash, and how many of each content
    left = a.select(F.col("phash").alias("left_phash"), "sha256", F.col("n").alias("m")).filter("left_phash is not null")
    met = cut(salted_join(left, pairs, "left_phash").groupBy(F.col("right_phash").alias("phash"), "sha256").agg(F.sum("m").alias("m")))
    near = lookup_join(b.filter("phash is not null"), met.groupBy("phash").agg(F.sum("m").alias("m")), "phash", "inner").select("sha256", "phash", *by, "n", "m")
    both = b.join(met.filter("sha256 is not null"), ["phash", "sha256"]).select("sha256", "phash", *by, "n", "m")
    parts = [(same, 1, 1), (near, 1, 0), (both, -1, 0)]
    rows = None
    for df, sign, content in parts:
        product = F.col("n") * F.col("m")
        part = df.select("sha256", "phash", *by, "n", (product * sign).alias("pairs"), (product * content).alias("same"))
        rows = part if rows is None else rows.unionByName(part)
    # a class of evaluation images counts once, by whichever criterion it was found
    per = rows.groupBy("sha256", "phash", *by).agg(F.max("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum("same").alias("same"))
    return per.groupBy(*by).agg(F.sum("n").alias("images"), F.sum("pairs").alias("pairs"), F.sum("same").alias("same_content_pairs"))
