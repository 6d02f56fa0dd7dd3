"""Places in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.checkpoints import checkpointed

#: Below are a row's place in its partition, above the partition, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33


def row_numbers(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with its rows' places from 1 in ``order`` as ``name``, a long.

    Ranges of the order are sorted each by itself (their bounds come of a sample) and written; how many rows the ranges before hold,
    one number a range, is what goes through the driver. Rows that are equal in the order lie in one range, in any order.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", PLACE_BITS)
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1) + 1).drop("_part", "_before", "_place")
