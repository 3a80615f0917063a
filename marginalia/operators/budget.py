"""A budget of rows and bytes over a whole scan: how far it reaches, and which row is the first beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reconcile import checkpointed


def reach(rows: DataFrame, order: list[str], size: str, budgets: list[tuple[int, int]]) -> DataFrame:
    """(most_rows, most_bytes, n_rows, n_bytes, limit, first columns of order) for each budget: the rows from the first on that keep within both,
    their bytes, which limit ends them (rows, bytes, or null if all rows fit), and the key of the first row beyond.

    Rows are sorted by range partitions and written once. The sums of partitions, one row each, tell in which of them a budget ends; only
    these partitions are summed row by row. A null size counts as 0. The order must be total; otherwise which of equal rows comes first is open."""
    spark = rows.sparkSession
    parted = rows.select(*order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(parted.withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], r["n"], r["b"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect())
    ends, n, b = {}, 0, 0
    for part, own_n, own_b in sums:
        for k, (most_n, most_b) in enumerate(budgets):
            if k not in ends and (n + own_n > most_n or b + own_b > most_b):
                ends[k] = (part, n, b)
        n, b = n + own_n, b + own_b
    key = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in order)
    whole = [(most_n, most_b, n, b, None, *[None] * len(order)) for k, (most_n, most_b) in enumerate(budgets) if k not in ends]
    out = spark.createDataFrame(whole, f"most_rows long, most_bytes long, n_rows long, n_bytes long, limit string, {key}")
    if not ends:
        return out
    asked = spark.createDataFrame([(k, *budgets[k], *at) for k, at in ends.items()], "k int, most_rows long, most_bytes long, _part int, n0 long, b0 long")
    w = Window.partitionBy("k").orderBy(*order)
    inside = stored.join(F.broadcast(asked), "_part")
    running = inside.withColumns({"n": F.col("n0") + F.row_number().over(w), "b": F.col("b0") + F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    over = running.filter((F.col("n") > F.col("most_rows")) | (F.col("b") > F.col("most_bytes")))
    first = over.groupBy("k").agg(F.min_by(F.struct("most_rows", "most_bytes", "n", "b", "_size", *order), "n").alias("r")).select("r.*")
    limit = F.when(F.col("n") > F.col("most_rows"), "rows").otherwise("bytes")
    return out.union(first.select("most_rows", "most_bytes", F.col("n") - 1, F.col("b") - F.col("_size"), limit, *order))
