"""Order inside a test without one task for a test: ranges of seq are ordered apart, only their borders meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.schema import TEST

#: Statements that one task orders, at most.
RANGE = 16_384


def meet(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows of ``left`` with what ``right`` has beside ``names``, null names included."""
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return left.join(right.withColumnsRenamed({c: f"b_{c}" for c in names}), same, how).drop(*[f"b_{c}" for c in names])


def positions(rows: DataFrame, part: Column | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``rows`` with ``position``: 1, 2, ... in each test in the order of ``part`` (ranges of seq), then ``order``."""
    at = (*TEST, "range_")
    x = rows.withColumn("range_", F.floor(F.col("seq") / RANGE) if part is None else part)
    counts = x.groupBy(*at).agg(F.count(F.lit(1)).alias("base_"))
    across = Window.partitionBy(*TEST).orderBy("range_")
    counts = counts.withColumn("base_", F.sum("base_").over(across) - F.col("base_"))
    x = x.withColumn("position", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    return meet(x, counts, at).withColumn("position", F.col("position") + F.col("base_")).drop("range_", "base_")
