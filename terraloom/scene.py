"""One scene from image to products: tiles, predictions, mosaic, calibration, heights above
ground, slope and mesh, as a list of stages whose events a listener can follow."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import scalars
from terraloom.functions.predictors import Predictor
from terraloom.operators import calibration, graph, ground, terrain, tiles
from terraloom.sources import sinks

#: Stage -> what a listener shows for it, in order.
STAGES = {
    "input": "Image",
    "tiling": "Tile plan",
    "prediction": "Relative heights",
    "elevation": "Elevation model",
    "calibration": "Calibration",
    "surface": "Surface",
    "uncertainty": "Uncertainty",
    "heights": "Heights above ground",
    "slope": "Slope",
    "mesh": "Mesh",
}


@dataclass(frozen=True)
class Options:
    """What a run can be told; lengths in metres where a scene has them, else in pixels."""

    method: str = "M2_smooth"
    tile: int = 1036
    overlap: int = 256
    align: str = "auto"
    lowpass: float = 30.0
    block: float = 154.0
    ground_window: float = 60.0
    max_slope: float = 10.0
    mesh_side: int = 512
    seed: int = 0
    gate: calibration.Gate = field(default_factory=calibration.Gate)


@dataclass(frozen=True)
class Scene:
    """An image (row, col, r, g, b: 8 bits) and, where it has a place on the map, its pixel
    size, coordinate system and elevation model on the same grid: row, col, dem, and if
    known water, dem_error, cell. `issue` tells why it has no place."""

    image: DataFrame
    pixel: tuple[float, float] | None = None
    crs: str | None = None
    elevation: DataFrame | None = None
    datum: str = "EGM2008"
    issue: str = "the image has no map coordinates"


class Journal:
    """Events of a run: each is kept, and handed to a listener at once."""

    def __init__(self, listener: Callable[[dict], None] | None = None, progress: Callable[[str, float], None] | None = None):
        self.listener, self.progress, self.events = listener, progress, []

    def note(self, kind: str, stage: str, **facts) -> None:
        """An event; a stage counts for 0.3 of its share when it begins."""
        event = {"type": kind, "stage": stage, "title": STAGES.get(stage, stage), "time": time.time(), **facts}
        self.events.append(event)
        if self.listener:
            self.listener(event)
        if self.progress and stage in STAGES:
            part = 0.3 if kind == "start" else 1.0
            self.progress(STAGES[stage], round((list(STAGES).index(stage) + part) / len(STAGES), 3))


class Run:
    """A scene's products so far: `layers` are tables, `facts` a report by stage."""

    def __init__(self, scene: Scene, predictor: Predictor, options: Options):
        self.scene, self.predictor, self.options = scene, predictor, options
        self.layers: dict[str, DataFrame] = {}
        self.facts: dict[str, dict] = {}
        self.placed = scene.pixel is not None and scene.elevation is not None
        self.metric = False

    def pixels(self, length: float) -> int:
        """A length of the options in pixels, 1 at least."""
        return max(1, round(length / self.scene.pixel[0])) if self.scene.pixel else max(1, round(length))

    # each stage fills layers and returns facts
    def input(self) -> dict:
        """The image's size."""
        self.height, self.width = (int(n) for n in self.scene.image.agg(F.max("row") + 1, F.max("col") + 1).first())
        return {"height": self.height, "width": self.width, "placed": self.placed, "crs": self.scene.crs}

    def tiling(self) -> dict:
        """A plan of overlapping tiles."""
        o = self.options
        self.plan = tiles.plan(self.scene.image.sparkSession, self.height, self.width, o.tile, o.overlap)
        self.layers["tiles"] = self.plan
        return {"tiles": self.plan.count(), "tile": o.tile, "overlap": o.overlap}

    def prediction(self) -> dict:
        """Every tile's prediction, fitted to its neighbours and blended."""
        o, p = self.options, self.predictor
        dealt = tiles.deal(self.scene.image, self.height, self.width, o.tile, o.overlap).join(self.plan.select("tile_id", "row0", "col0"), ["row0", "col0"])
        bands = dealt.select("tile_id", "row", "col", "r", "g", "b")
        preds = graph.cut(tiles.predict(bands, lambda crop: p(crop.astype(np.uint8)), ["r", "g", "b"]))
        align = o.align if o.align != "auto" else "sequential" if self.placed else "joint"
        fits: list[dict] = []
        if align == "sequential":
            mosaic, fits = tiles.align_sequential(preds, [r.asDict() for r in self.plan.orderBy("tile_id").collect()], o.overlap)
        elif align in ("joint", "none"):
            x = preds.join(self.plan, "tile_id")
            if align == "joint":
                fits = tiles.align_joint(preds, self.plan, self.height, self.width, min_strip_px=min(100, o.overlap))
                rows = [tuple(f[k] for k in ("tile_id", "a", "b", "c", "d")) for f in fits]
                made = preds.sparkSession.createDataFrame(rows, "tile_id int, fa double, fb double, fc double, fd double")
                plane = F.col("fc") * F.col("col") / self.width + F.col("fd") * F.col("row") / self.height
                x = x.join(made, "tile_id").withColumn("p", F.col("fa") * F.col("p") + F.col("fb") + plane)
            mosaic = tiles.blend(x, o.overlap)
        else:
            raise ValueError(f"tiles can't be aligned by {align!r}")
        self.layers["relative"] = graph.cut(mosaic)
        return {"model": p.name, "polarity": p.polarity, "height_sign": p.height_sign, "align": align, "fits": fits}

    def elevation(self) -> dict:
        """The elevation model on the image's grid, with what is missing from it."""
        x = self.scene.elevation
        for name, kind in (("water", "boolean"), ("dem_error", "double"), ("cell", "long")):
            if name not in x.columns:
                x = x.withColumn(name, F.lit(None).cast(kind))
        self.layers["elevation"] = x.select("row", "col", "dem", "water", F.coalesce("dem_error", F.lit(0.0)).alias("dem_error"), F.coalesce("cell", F.lit(0).cast("long")).alias("cell"))
        got = x.agg(F.avg(F.col("dem").isNotNull().cast("double")).alias("coverage"), F.avg(F.col("water").cast("double")).alias("water")).first()
        return {"datum": self.scene.datum, **got.asDict()}

    def calibration(self) -> dict:
        """The relative surface in metres, if the gates let it pass."""
        o = self.options
        grid = self.layers["relative"].withColumnRenamed("v", "r").join(self.layers["elevation"], ["row", "col"])
        tilt = terrain.slope(self.layers["elevation"].select("row", "col", F.col("dem").alias("v")), self.scene.pixel)
        grid = grid.join(tilt.select("row", "col", "slope"), ["row", "col"])
        grid = grid.withColumn("fit", scalars.checkerboard(F.col("row"), F.col("col"), max(8, self.pixels(o.block))))
        out, report = calibration.calibrate(grid, o.method, o.gate, o.max_slope, lowpass_px=self.pixels(o.lowpass), seed=o.seed)
        self.metric = bool(report["metric"])
        self.layers["calibrated"] = graph.cut(out)
        return report

    def surface(self) -> dict:
        """The metric surface, or the relative one with the reasons."""
        if self.metric:
            self.layers["surface"] = self.layers["calibrated"].select("row", "col", F.col("z").alias("v"))
            return {"kind": "absolute", "units": "metres", "vertical_datum": self.scene.datum}
        self.layers["surface"] = self.layers["relative"].select("row", "col", "v")
        return {"kind": "relative", "units": "none", "reasons": self.facts["calibration"]["reasons"] if self.placed else [self.scene.issue]}

    def uncertainty(self) -> dict:
        """One standard error of the surface, and where it is not to be relied on."""
        self.layers["uncertainty"] = self.layers["calibrated"].select("row", "col", F.col("sigma").alias("v"), "low_confidence")
        return self.layers["uncertainty"].agg(F.avg("v").alias("mean"), F.avg(F.col("low_confidence").cast("double")).alias("low")).first().asDict()

    def heights(self) -> dict:
        """Ground under the surface, heights above it, and their confidence."""
        g = graph.cut(ground.estimate_ground(self.layers["surface"], max(8, self.pixels(self.options.ground_window))))
        x = g.join(self.layers["uncertainty"].select("row", "col", F.col("v").alias("sigma")), ["row", "col"]).join(self.layers["elevation"].select("row", "col", "water"), ["row", "col"])
        why = scalars.confidence_reasons(F.col("ndsm"), F.col("low_confidence"), water=F.col("water"), sigma=F.col("sigma"))
        x = x.withColumn("reasons", why).withColumn("level", scalars.confidence_level(F.col("ndsm"), F.col("reasons")))
        self.layers["heights"] = x.select("row", "col", "ground", F.col("ndsm").alias("v"), "level", "reasons")
        return self.layers["heights"].agg(F.avg("v").alias("mean"), F.max("v").alias("highest"), F.avg((F.col("level") == 1).cast("double")).alias("low")).first().asDict()

    def slope(self) -> dict:
        """Slope of the surface in degrees."""
        self.layers["slope"] = terrain.slope(self.layers["surface"], self.scene.pixel).select("row", "col", F.col("slope").alias("v"))
        return self.layers["slope"].agg(F.avg("v").alias("mean"), F.max("v").alias("steepest")).first().asDict()

    def mesh(self) -> dict:
        """A mesh of at most mesh_side pixels a side."""
        factor = max(1, -(-max(self.height, self.width) // self.options.mesh_side))
        step = self.scene.pixel if self.metric else (1.0, 1.0)
        small = graph.cut(terrain.block_mean(self.layers["surface"], factor))
        self.layers["vertices"], self.layers["faces"] = terrain.mesh(small, step[0] * factor, step[1] * factor)
        return {"decimation": factor, "vertices": self.layers["vertices"].count(), "faces": self.layers["faces"].count()}

    def skipped(self, stage: str) -> str | None:
        """Why a stage can't run, if so."""
        if stage in ("elevation", "calibration") and not self.placed:
            return f"{self.scene.issue}: the output stays relative"
        if stage in ("uncertainty", "heights", "slope") and not self.metric:
            return "only a metric surface has it"
        return None


def build(scene: Scene, predictor: Predictor, options: Options | None = None, listener: Callable[[dict], None] | None = None, progress: Callable[[str, float], None] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Layers by name and the run's report.

    A stage that fails is noted and its error raised; stages that need a place on the map
    or a metric surface are skipped with the reason where there is none. Large tables stay
    in Spark; facts are a row a stage."""
    run, journal = Run(scene, predictor, options or Options()), Journal(listener, progress)
    for stage in STAGES:
        if why := run.skipped(stage):
            journal.note("skipped", stage, reason=why)
            continue
        journal.note("start", stage)
        began = time.perf_counter()
        try:
            run.facts[stage] = getattr(run, stage)()
        except Exception as error:
            journal.note("failed", stage, error=f"{type(error).__name__}: {error}")
            raise
        journal.note("done", stage, seconds=round(time.perf_counter() - began, 3), facts=run.facts[stage])
    report = {"product": run.facts["surface"], "stages": journal.events, "facts": run.facts, "options": asdict(run.options), "layers": sorted(run.layers)}
    return run.layers, report


def write(layers: dict[str, DataFrame], report: dict, path: str, crs: str | None = None) -> None:
    """The surface with its guarded sidecar and every other layer, as Parquet under a path
    that the cluster shares."""
    product = report["product"]
    sinks.write_surface(layers["surface"], f"{path}/surface", product["kind"], product["units"], crs, product.get("vertical_datum"))
    for name, df in layers.items():
        if name != "surface":
            df.write.parquet(f"{path}/{name}")
