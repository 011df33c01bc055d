"""Extension for rows that arrive live: incremental voxel thinning by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thin_stream(points: DataFrame, voxel: float, *, time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """One point for each voxel of each capture within the watermark; state is dropped behind it."""
    keyed = points.withWatermark(time, lateness).withColumns({f"k{a}": F.floor(F.col(a) / voxel) for a in ("x", "y", "z")})
    return keyed.dropDuplicatesWithinWatermark(["capture_id", "kx", "ky", "kz"])
