"""Utilisation-fleet time-series analytics as Spark DataFrame operators.

Every operator takes and returns a DataFrame.  The central table is long:
``env, series_id, bucket, y`` - one row per series and grid cell, with NULL
(never NaN) for a missing measurement.
"""

from tidemark.config import FleetSpec

__all__ = ["FleetSpec"]
