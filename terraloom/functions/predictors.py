"""Depth predictors: the interface that a model fills, a registry, and a deterministic
stand-in, so that everything behind a model can be run and tested without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Predictor:
    """A map from an 8-bit crop (h, w, 3) to a relative height map (h, w)."""

    name: str
    run: Callable[[np.ndarray], np.ndarray]
    height_sign: int = 1
    polarity: str = "higher is nearer"

    def __call__(self, crop: np.ndarray) -> np.ndarray:
        if crop.ndim != 3 or crop.shape[2] != 3 or crop.dtype != np.uint8:
            raise ValueError("a crop has the shape (h, w, 3) and 8 bits")
        if self.height_sign not in (-1, 1):
            raise ValueError("height sign must be 1 or -1")
        out = np.asarray(self.run(crop), np.float64)
        return self.height_sign * (out if out.shape == crop.shape[:2] else resize(out, crop.shape[:2]))


def resize(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resize by pixel centres, edges held."""
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, a.shape, strict=True)]
    low = [np.floor(x).astype(int) for x in at]
    high = [np.minimum(x + 1, m - 1) for x, m in zip(low, a.shape, strict=True)]
    fr, fc = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    top = a[np.ix_(low[0], low[1])] * (1 - fc) + a[np.ix_(low[0], high[1])] * fc
    bottom = a[np.ix_(high[0], low[1])] * (1 - fc) + a[np.ix_(high[0], high[1])] * fc
    return top * (1 - fr) + bottom * fr


REGISTRY: dict[str, Callable[[], Predictor]] = {
    "red": lambda: Predictor("red", lambda crop: crop[..., 0]),
    "half": lambda: Predictor("half", lambda crop: crop[::2, ::2, 0], -1, "higher is farther"),
}


@lru_cache(maxsize=1)
def load(name: str) -> Predictor:
    """A registered predictor; a worker holds one at a time."""
    if name not in REGISTRY:
        raise ValueError(f"unknown predictor {name!r}")
    return REGISTRY[name]()


def predict(tiles: DataFrame, name: str) -> DataFrame:
    """(tile_id, h, w, data) of a predictor over tiles (tile_id, h, w, rgb: flat bytes),
    in Arrow batches; the model is loaded once in each worker."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            p = load(name)
            data = [p(np.frombuffer(bytes(x), np.uint8).reshape(h, w, 3)).ravel() for x, h, w in zip(pdf["rgb"], pdf["h"], pdf["w"], strict=True)]
            yield pdf[["tile_id", "h", "w"]].assign(data=data)

    return tiles.select("tile_id", "h", "w", "rgb").mapInPandas(run, "tile_id long, h int, w int, data array<double>")
