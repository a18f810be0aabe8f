"""The stabiliser as a job: parameters from JSON, warps as a recipe that can be applied again, and a name for its output."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layout, register, spatial
from .sources import images, sinks

#: Names of models in parameters.
MODELS = {"shifts": "shift", "affine": "affine", "homography": "homography", "Greenberg-Kerr": "line_scan", "softmesh": "mesh"}

#: Names of the models' parameters, where they differ.
NAMES = {"wsize": "size"}


@dataclass
class Stabiliser:
    """Channel, filters before fitting as [name, parameter], models as names or [name, parameters], template or recursive, and the output's suffix."""

    ch: int = 0
    smooth: list = field(default_factory=list)
    model: list = field(default_factory=lambda: ["softmesh"])
    type: str = "template"
    suff: str = "stab"
    name: str = ""

    @staticmethod
    def of_json(text: str, **more) -> Stabiliser:
        """Parameters that JSON states over those given; others it may state are left out."""
        known = {f.name for f in fields(Stabiliser)}
        return Stabiliser(**{k: v for k, v in (more | json.loads(text)).items() if k in known})

    def suffix(self) -> str:
        """What is added to an input's name: the parameters' name, or the channel, filters, type and models; then the suffix."""
        models = [m if isinstance(m, str) else m[0] for m in self.model]
        parts = [self.name, self.suff] if self.name else [f"ch_{self.ch}", *[f"{n}_{p[0] if p else _default(n)}" for n, *p in self.smooth], self.type, *models, self.suff]
        return "-" + "-".join(parts)

    def run(self, frames: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(stabilised frames, the warps of each model); models are fitted to filtered frames and applied to the frames as they are."""
        if self.type not in ("template", "recursive"):
            raise ValueError(f"unknown type {self.type}")
        seen, out, all_ = smoothed(frames, self.smooth), frames, []
        for m in self.model:
            kind, more = (m, {}) if isinstance(m, str) else (m[0], m[1] if len(m) > 1 else {})
            if kind not in MODELS:
                raise ValueError(f"unknown model {kind}; there are {', '.join(MODELS)}")
            if self.type == "recursive":
                warps = register.register_recursive(seen)
            else:
                n = seen.count()
                warps = register.register_model(seen, register.template(layout.frames_to_cells(seen), n // 2, min(n, n // 2 + 50)), MODELS[kind], **{NAMES.get(k, k): v for k, v in more.items()})
            all_.append(warps)
            seen, out = register.apply_warps(seen, warps), register.apply_warps(out, warps)
        return out, all_


def _default(name: str) -> float:
    return 3 if name == "median" else 1


def smoothed(frames: DataFrame, filters: list) -> DataFrame:
    """Frames after filters: gauss with a deviation, or median of 3 x 3."""
    for name, *par in filters:
        cells = layout.frames_to_cells(frames)
        if name == "gauss":
            cells = spatial.gauss_blur(cells, float(par[0] if par else _default(name)))
        elif name == "median":
            cells = spatial.median3(cells)
        else:
            raise ValueError(f"unknown filter {name}")
        frames = layout.to_frames(cells)
    return frames


def save_recipe(warps: list[DataFrame], path: str) -> None:
    """Warps of each model, numbered in the order in which they are applied."""
    for k, w in enumerate(warps):
        w.write.parquet(f"{path}/step={k:03d}")


def load_recipe(spark: SparkSession, path: str) -> list[DataFrame]:
    all_ = spark.read.option("basePath", path).parquet(path)
    return [all_.filter(F.col("step") == r["step"]).drop("step") for r in all_.select("step").distinct().orderBy("step").collect()]


def apply_recipe(frames: DataFrame, warps: list[DataFrame]) -> DataFrame:
    for w in warps:
        frames = register.apply_warps(frames, w)
    return frames


def read_parameters(spark: SparkSession, path: str) -> str:
    """The text of a parameter file on any storage that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def main(argv: list[str]) -> None:
    """`parameters.json input output`: stabilised frames as Parquet and the recipe beside them, in folders named after the input."""
    spark = SparkSession.builder.getOrCreate()
    job = Stabiliser.of_json(read_parameters(spark, argv[0]))
    frames = images.open_seq(spark, argv[1], job.ch).select("t", "h", "w", "data")
    out, warps = job.run(frames)
    base = f"{argv[2].rstrip('/')}/{argv[1].rstrip('/').rsplit('/', 1)[-1]}{job.suffix()}"
    save_recipe(warps, f"{base}-recipe")
    sinks.write_sequences({"stabilised": layout.frames_to_cells(out)}, base)


if __name__ == "__main__":
    main(sys.argv[1:])
