"""Functions on arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(granted: Column, required: list[str], wildcard: str = "all") -> Column:
    """What is required and not granted, in the order required; nothing if the wildcard is granted. Null grants nothing."""
    none = F.array().cast("array<string>")
    held = F.coalesce(granted, none)
    return F.when(F.array_contains(held, wildcard), none).otherwise(F.array_except(F.array(*(F.lit(x) for x in required)), held))
