"""Global order without a global sort in one task: range partitions, a number within each, and the sizes of those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reconcile import checkpointed

#: The low bits of monotonically_increasing_id count the rows of a partition.
_ROW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with a number from 0 in a total order. The sorted rows are written once; only the sizes of the partitions come to the
    driver, a row for each partition."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(parted.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}))
    sizes = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return stored.join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def with_neighbours(rows: DataFrame, value: str, ordinal: str = "ordinal", block: int = 100_000) -> DataFrame:
    """rows with neighbours, the values before and after in the global order. Blocks of numbers are windows of their own; the rows at
    their edges stand in both."""
    own = F.floor(F.col(ordinal) / block)
    inside = F.col(ordinal) % block
    copies = F.array_compact(F.array(own, F.when(inside == 0, own - 1), F.when(inside == block - 1, own + 1)))
    spread = rows.withColumn("_block", F.explode(copies))
    w = Window.partitionBy("_block").orderBy(ordinal)
    near = F.array_compact(F.array(F.lag(value).over(w), F.lead(value).over(w)))
    return spread.withColumn("neighbours", near).filter(F.col("_block") == own).drop("_block")
