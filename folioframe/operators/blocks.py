"""Block-level geometry that needs a hull."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain over integer points."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _narrowest_box(xs, ys):
    """Smallest box over the hull's side directions: centre, w, h, angle."""
    hull = _hull(np.stack([xs, ys], axis=1)).astype("float64")
    if len(hull) == 1:
        return (hull[0][0], hull[0][1], 0.0, 0.0, 0.0)
    sides = np.roll(hull, -1, axis=0) - hull
    best = None
    for dx, dy in sides:
        theta = np.arctan2(dy, dx)
        u = np.array([dx, dy]) / np.hypot(dx, dy)
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        w, h = np.ptp(along), np.ptp(across)
        mid = ((along.min() + along.max()) / 2) * u + ((across.min() + across.max()) / 2) * np.array([-u[1], u[0]])
        key = (round(w * h, 9), theta)
        if best is None or key < best[0]:
            best = (key, (mid[0], mid[1], w, h, theta))
    return best[1]


_OBB = StructType([StructField(n, DoubleType()) for n in ("x", "y", "w", "h", "theta")])


@F.pandas_udf(_OBB)
def _obb(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [_narrowest_box(x, y) for x, y in zip(xs, ys)], columns=["x", "y", "w", "h", "theta"]
    )


def with_obb(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Add ``obb``, the minimum-area box around all corners of a block."""
    corners = F.flatten(F.col(lines))
    xs = F.transform(corners, lambda p: p["x"])
    ys = F.transform(corners, lambda p: p["y"])
    return df.withColumn("obb", _obb(xs, ys))
