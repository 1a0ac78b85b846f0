"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import components
from tessera.session import stored

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "ascii_lower", "components", "stored", "width"]

# ---- fixed values: ASCII letters and the white space the text contracts name ----
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"
# ---------------------------------------------------------------------------------


def width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that none gets more than about ``per_task`` rows; never below the session's width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def ascii_lower(col):
    """A-Z to a-z, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)
