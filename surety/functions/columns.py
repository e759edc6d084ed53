"""Small helpers shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends, as Unicode counts it."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def zero(x) -> Column:
    return F.coalesce(x, F.lit(0.0))
