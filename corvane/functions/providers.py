"""Detectors as table functions: a protocol, a stub, a tiling wrapper and an orchestrator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as G

EVIDENCE = "image_id bigint, provider string, confidence double, x0 double, y0 double, x1 double, y1 double"


class ProviderUnavailable(Exception):
    """The detector cannot run here; recorded, unlike any other error."""


class Provider:
    """A detector: ``name`` and ``analyze``, from a batch of images (image_id, width, height) to evidence rows."""

    name = "provider"

    def check(self) -> None:
        """Raises ProviderUnavailable where the detector cannot run."""

    def analyze(self, images: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class StubProvider(Provider):
    """One box a quarter of the image in from each side; for tests and as a pattern."""

    def __init__(self, name: str = "stub", confidence: float = 0.5) -> None:
        self.name, self.confidence = name, confidence

    def analyze(self, images: pd.DataFrame) -> pd.DataFrame:
        w, h = images["width"], images["height"]
        return pd.DataFrame({"image_id": images["image_id"], "provider": self.name, "confidence": self.confidence, "x0": w / 4, "y0": h / 4, "x1": 3 * w / 4, "y1": 3 * h / 4})


def run_provider(images: DataFrame, provider: Provider) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield provider.analyze(pdf)

    return images.select("image_id", "width", "height").mapInPandas(run, EVIDENCE)


def run_tiled(images: DataFrame, provider: Provider, **plan: float) -> DataFrame:
    """``provider`` on each tile of the tile plan, boxes moved back into the image and clipped; its name gets ``_tiled``."""
    tiles = images.select("image_id", "width", "height", F.explode(G.tile_plan(F.col("width"), F.col("height"), **plan)).alias("t"))
    tiles = tiles.withColumn("tile", F.struct("image_id", "width", "height", "t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf.reset_index(drop=True)
            found = provider.analyze(pd.DataFrame({"image_id": own.index, "width": own["x1"] - own["x0"], "height": own["y1"] - own["y0"]}))
            at = own.loc[found["image_id"]].reset_index(drop=True)
            found = found.reset_index(drop=True)
            yield pd.DataFrame({"image_id": at["image_id"], "left": at["x0"], "top": at["y0"], "width": at["width"], "height": at["height"], "provider": provider.name + "_tiled", **{c: found[c] for c in ("confidence", "x0", "y0", "x1", "y1")}})

    schema = "image_id bigint, left int, top int, width int, height int, provider string, confidence double, x0 double, y0 double, x1 double, y1 double"
    found = tiles.select("image_id", "width", "height", "t.*").mapInPandas(run, schema)
    box = G.tile_to_image(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("left"), F.col("top"), F.col("width"), F.col("height"))
    return found.select("image_id", "provider", "confidence", box.alias("b")).filter("b is not null").select("image_id", "provider", "confidence", "b.*")


def orchestrate(images: DataFrame, providers: list[Provider], runner: Callable[[DataFrame, Provider], DataFrame] = run_provider) -> tuple[DataFrame, DataFrame]:
    """(evidence, status): the union of all available providers' rows, and (provider, status, error); names must differ, other errors propagate."""
    if len({p.name for p in providers}) < len(providers):
        raise ValueError("two providers share a name")
    frames, status = [], []
    for p in providers:
        try:
            p.check()
            frames.append(runner(images, p))
            status.append((p.name, "ok", None))
        except ProviderUnavailable as e:
            status.append((p.name, "unavailable", str(e)))
    spark = images.sparkSession
    evidence = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], EVIDENCE)
    return evidence, spark.createDataFrame(status, "provider string, status string, error string")
