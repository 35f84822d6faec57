"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which are counted; else as it is, for a join by shuffling.

    For tables whose size the planner can't know, such as those made from local rows. The other side of such a join is hinted ``merge``, as exploded rows look as small to the
    planner as what they come from."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
