"""Durations and elapsed time."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(text: str) -> timedelta:
    """``"10 seconds"``, ``"2 hours"``, ... as a timedelta."""
    return pd.Timedelta(text).to_pytimedelta()


def interval(text: str) -> Column:
    return F.lit(duration(text))


def time_slice(column, width: str) -> Column:
    """Start of the fixed-width slice of the time line that holds a timestamp.

    Works for both timestamp types and does not depend on the session zone for those without one.
    """
    return F.window(column, width)["start"]


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds, fractions kept."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros / F.lit(1_000_000.0)
