"""Comparing two sides by key: differences, partitions, uniqueness, closure and reference resolution."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir; a local one is set only where none is, in local mode. On a cluster
    that would be another folder on every machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        import tempfile

        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}")
    return df.checkpoint()


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def differences(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, status) of every key: same, changed, missing (only left) or unexpected (only right). Nulls equal nulls."""
    pick = lambda df, side: df.select(*key, *(F.col(v).alias(f"{side}_{v}") for v in values), F.lit(True).alias(side))
    both = pick(left, "l").join(pick(right, "r"), key, "full_outer")
    equal = reduce(lambda a, b: a & b, (F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}")) for v in values), F.lit(True))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(equal, "same").otherwise("changed")
    return both.select(*key, status.alias("status"))


def counts_of(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(column) == n).alias(n) for n in names), F.count("*").alias("total"))


def expected_keys(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of each expected key: ok, missing, duplicate or changed."""
    seen = found.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("seen"))
    joined = expected.join(seen, key, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("seen").eqNullSafe(F.col(value)), "ok").otherwise("changed")
    return joined.select(key, status.alias("status"))


def partition_check(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that aren't in exactly one part, or in a part but not in the whole."""
    tagged = reduce(DataFrame.unionByName, (p.select(key, F.lit(name).alias("part")) for name, p in parts.items()))
    rows = whole.select(key, F.lit("").alias("part")).unionByName(tagged)
    sums = rows.groupBy(key).agg(F.count_if(F.col("part") != "").alias("n"), F.bool_or(F.col("part") == "").alias("known"))
    return sums.filter((F.col("n") != 1) | ~F.col("known"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all that edges (source, target) reach from roots (node), breadth first.

    The frontier joins the edges on their source in every round; what was seen goes by an anti join. Both are written to the
    shared folder, so plans stay short and lost executors repeat one round at most. Joins are by sorting, since a broadcast in every round would
    go through the driver."""
    frontier = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        after = edges.hint("merge").join(frontier, edges["source"] == frontier["node"]).select(F.col("target").alias("node")).distinct()
        frontier = checkpointed(after.hint("merge").join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def cyclic(edges: DataFrame) -> DataFrame:
    """(source, target): the edges left when edges into nodes without outgoing ones are taken away again and again. Empty if there
    is no cycle."""
    left = checkpointed(edges.select("source", "target").distinct())
    while True:
        kept = checkpointed(left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if kept.count() == left.count():
            return kept
        left = kept


def resolve_references(refs: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """refs: (source, name); files: (path). A name stands for a path with one of the suffixes, in any case: (source, name,
    status, target) with status found, missing or ambiguous."""
    options = refs.withColumn("option", F.explode(F.array(*(F.lower(F.concat(F.col("name"), F.lit(s))) for s in suffixes))))
    joined = options.join(files.select("path", F.lower("path").alias("option")), "option", "left")
    got = joined.groupBy("source", "name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    return got.select(
        "source",
        "name",
        F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("status"),
        F.when(F.col("n") == 1, F.col("path")).alias("target"),
    )


def feature_status(source: DataFrame, output: DataFrame) -> DataFrame:
    """source and output: (feature, n). preserved, degraded (fewer), unsupported (none) or failed (more than the source has)."""
    s, o = source.select("feature", F.col("n").alias("source_n")), output.select("feature", F.col("n").alias("output_n"))
    both = s.join(o, "feature", "full_outer").na.fill(0, ["source_n", "output_n"])
    a, b = F.col("source_n"), F.col("output_n")
    return both.select("feature", "source_n", "output_n", F.when(a == b, "preserved").when(b > a, "failed").when(b == 0, "unsupported").otherwise("degraded").alias("status"))


def apportion(rows: DataFrame, group: list[str], weight: str, total: int, order: str) -> DataFrame:
    """Largest remainder: whole shares of total in proportion to weight that add up to it; ties go to the first in order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group)
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(w)
    sized = rows.withColumn("exact", exact).withColumn("share", F.floor("exact"))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("share")), order))
    return sized.withColumns({"left": F.lit(total) - F.sum("share").over(w), "rank": rank}).withColumn(
        "share", (F.col("share") + (F.col("rank") <= F.col("left")).cast("int")).cast("long")
    ).drop("exact", "left", "rank")
