"""Order-dependent operators over revision events: pairing, shapes, first-seen lists, chains, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordinals import numbered


def adjacent_pairs(events: DataFrame, group: list[str], order: list[str], pairs: Column) -> DataFrame:
    """events with pair_start, true on the first row of each pair. pairs says whether a row and its successor may pair (it may
    use F.lead over the column ``next``: a struct of the successor's columns). Pairs are taken greedily from the left and
    don't overlap: within a run of rows that may pair, every other one does."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = events.withColumn("next", F.lead(F.struct(*events.columns)).over(w)).withColumn("may", F.coalesce(pairs, F.lit(False)))
    island = F.sum(F.when(F.col("may"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("island", F.when(F.col("may"), island))
    place = F.row_number().over(Window.partitionBy(*group, "island").orderBy(*order))
    return marked.withColumn("pair_start", F.col("may") & (place % 2 == 1)).drop("may", "island")


def move_pairs(events: DataFrame, key: list[str], kind: str = "kind", id_: str = "event_id") -> DataFrame:
    """One row per key: the ids of its move_from and move_to if it has exactly one of both, else a conflict."""
    one = lambda k: F.count_if(F.col(kind) == k)
    pick = lambda k: F.min(F.when(F.col(kind) == k, F.col(id_)))
    sums = events.filter(F.col(kind).isin("move_from", "move_to")).groupBy(*key).agg(
        one("move_from").alias("n_from"), one("move_to").alias("n_to"), pick("move_from").alias("a"), pick("move_to").alias("b")
    )
    paired = (F.col("n_from") == 1) & (F.col("n_to") == 1)
    return sums.select(
        *key,
        F.when(paired, "paired").otherwise("conflict").alias("status"),
        F.when(paired, F.col("a")).alias("from_id"),
        F.when(paired, F.col("b")).alias("to_id"),
    )


def change_shape(kinds: Column) -> Column:
    """Kind of the change that a group of events makes, from its ordered kinds."""
    return (
        F.when(kinds == F.array(F.lit("insert")), "insertion")
        .when(kinds == F.array(F.lit("delete")), "deletion")
        .when(F.array_sort(kinds) == F.array(F.lit("delete"), F.lit("insert")), "replacement")
        .when(F.array_sort(kinds) == F.array(F.lit("move_from"), F.lit("move_to")), "move")
        .when(kinds == F.array(F.lit("comment")), "comment")
        .otherwise("structural")
    )


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, rank): the distinct non-null values in the order in which they first stand. Only one row per value is ranked, in range
    partitions."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("at"))
    return numbered(firsts, ["at", value]).select(value, (F.col("ordinal") + 1).alias("rank"))


def keep(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row per key: the first in order, or the last."""
    pick = (F.max_by if last else F.min_by)(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(pick.alias("r")).select("r.*")


def chain_violations(log: DataFrame, key: str, number: str, own: str, previous: str, first: int = 0) -> DataFrame:
    """Rows that break a log: numbers must run on from ``first``, and previous must be the own hash of the row before."""
    w = Window.partitionBy(key).orderBy(number)
    before = F.lag(own).over(w)
    expected = F.row_number().over(w) - 1 + first
    return log.withColumns({"expected": expected, "before": before}).filter(
        (F.col(number) != F.col("expected")) | ~F.col("before").eqNullSafe(F.col(previous))
    )


def not_increasing(rows: DataFrame, key: list[str], order: list[str], value: str, strict: bool = True) -> DataFrame:
    """Rows whose value isn't above (strict) or is below that of the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(w)
    return rows.withColumn("before", before).filter(F.col(value) <= F.col("before") if strict else F.col(value) < F.col("before"))


def unbalanced(markers: DataFrame, key: list[str], order: str, opens: str) -> DataFrame:
    """Keys whose markers aren't exactly one opening followed by one closing. Nothing is gathered per key."""
    seen = markers.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(opens, order).alias("first"), F.max_by(opens, order).alias("last"))
    return seen.filter((F.col("n") != 2) | ~F.col("first") | F.col("last")).select(*key)


def nesting(markers: DataFrame, key: list[str], order: str) -> DataFrame:
    """markers: kind is begin, separate or end. Adds the depth after each marker; key is malformed if it falls below 0, doesn't
    end at 0, or a separate stands outside."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    deep = markers.withColumn("depth", F.sum(step).over(w))
    wrong = (F.col("depth") < 0) | ((F.col("kind") == "separate") & (F.col("depth") < 1))
    return deep.groupBy(*key).agg(
        F.max("depth").alias("deepest"), (F.bool_or(wrong) | (F.max_by("depth", order) != 0)).alias("malformed")
    )


def as_of(rows: DataFrame, directives: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value of the latest directive of their key that stands before them: one sort, no range join."""
    both = rows.select("*", F.lit(None).cast(directives.schema[value].dataType).alias(value), F.lit(1).alias("own")).unionByName(
        directives.select(key, at, value, F.lit(0).alias("own")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("own = 1").drop("own")
