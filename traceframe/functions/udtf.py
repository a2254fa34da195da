"""Table function in Python: arc-length resampling of one stroke, as SQL can call it. The native form is the default."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class ResampleStroke:
    """Samples of one stroke at about `step` of arc: max(2, round(arc / step) + 1), ends exact.

    Called with a table partitioned by stroke and ordered by position; columns x and y are read by name.
    """

    def __init__(self) -> None:
        self.points: list[tuple[float, float]] = []
        self.step = 0.0

    def eval(self, row: Row, step: float) -> None:
        self.points.append((row["x"], row["y"]))
        self.step = step
        self.keys = row["case_id"], row["stroke"]

    def terminate(self):
        if not self.points:
            return
        pts = np.array(self.points, dtype=float)
        arc = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(pts, axis=0).T))])
        n = max(2, round(arc[-1] / self.step) + 1) if arc[-1] > 0 else 2
        wanted = arc[-1] * np.arange(n) / (n - 1)
        at = np.clip(np.searchsorted(arc, wanted, side="right") - 1, 0, max(len(pts) - 2, 0))
        after = np.minimum(at + 1, len(pts) - 1)
        length = arc[after] - arc[at]
        f = np.divide(wanted - arc[at], length, out=np.zeros(n), where=length > 0)[:, None]
        out = pts[at] + f * (pts[after] - pts[at])
        out[-1] = pts[-1]
        for i, (x, y) in enumerate(out.tolist()):
            yield *self.keys, i, x, y


def register_resample(spark: SparkSession, name: str = "resample") -> None:
    """Make `SELECT * FROM resample(TABLE(t) PARTITION BY (case_id, stroke) ORDER BY (pos), step)` known to the session."""
    made = udtf(ResampleStroke, returnType="case_id bigint, stroke bigint, i bigint, x double, y double")
    spark.udtf.register(name, made)
