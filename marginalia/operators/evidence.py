"""Joins between changes and what belongs to them: bindings, decisions, raw events, diagnostics, artifacts, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reconcile import checkpointed


def bound(changes: DataFrame, bindings: DataFrame, name: str) -> DataFrame:
    """changes with the unit that their bookmark is bound to; a null name is bound to nothing."""
    return changes.join(bindings.select(name, "unit_id"), name, "left")


def matched(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(change_id, status) of all ids of both: ok, missing (undecided), unexpected, repeated, order or fingerprint.

    changes and decisions: (change_id, position, fingerprint). Each change is decided once, at its position, over its fingerprint."""
    own = decisions.groupBy("change_id").agg(F.count("*").alias("times"), F.min("position").alias("at"), F.min("fingerprint").alias("seen"))
    both = changes.join(own, "change_id", "full_outer")
    status = (
        F.when(F.col("times").isNull(), "missing")
        .when(F.col("fingerprint").isNull(), "unexpected")
        .when(F.col("times") > 1, "repeated")
        .when(F.col("at") != F.col("position"), "order")
        .when(F.col("seen") != F.col("fingerprint"), "fingerprint")
        .otherwise("ok")
    )
    return both.select("change_id", status.alias("status"))


def with_events(changes: DataFrame, events: DataFrame, value: Column) -> DataFrame:
    """(change_id, values, missing): what value gives for each of a change's raw_event_ids, in their order, and how many aren't known."""
    each = changes.select("change_id", F.posexplode("raw_event_ids").alias("at", "event_id"))
    found = each.join(events.withColumn("value", value).select("event_id", "value", F.lit(True).alias("known")), "event_id", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("known"), F.struct("at", "value")))), lambda x: x["value"])
    return found.groupBy("change_id").agg(ordered.alias("values"), F.count_if(F.col("known").isNull()).alias("missing"))


def with_diagnostics(changes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(change_id, diagnostic_id), each pair once: diagnostics that name the change or its unit. Two equi joins instead of one with OR.

    changes: (change_id, unit_id); diagnostics: (diagnostic_id, change_id, unit_id)."""
    d = diagnostics.select("diagnostic_id", F.col("change_id").alias("c"), F.col("unit_id").alias("u"))
    by_change = changes.select("change_id").join(d, F.col("change_id") == F.col("c")).select("change_id", "diagnostic_id")
    by_unit = changes.filter("unit_id IS NOT NULL").join(d, F.col("unit_id") == F.col("u")).select("change_id", "diagnostic_id")
    return by_change.union(by_unit).distinct()


def selected_artifacts(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """files (path, role, size, sha256) with the one artifact_id that has all four; status found, missing or ambiguous."""
    key = ["path", "role", "size", "sha256"]
    ids = artifacts.groupBy(*key).agg(F.count_distinct("artifact_id").alias("n"), F.min("artifact_id").alias("artifact_id"))
    joined = files.join(ids, key, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return joined.select("path", status.alias("status"), F.when(F.col("n") == 1, F.col("artifact_id")).alias("artifact_id"))


def unauthorised(entries: DataFrame, authorised: DataFrame, bundled: DataFrame) -> DataFrame:
    """(entry, rule): entries whose binding isn't authorised, or whose document isn't in the bundle. Both anti joins are empty for a
    sound bundle. entries: (entry, binding, document)."""
    one = entries.join(authorised.select("binding").distinct(), "binding", "left_anti").select("entry", F.lit("authorised").alias("rule"))
    two = entries.join(bundled.select("document").distinct(), "document", "left_anti").select("entry", F.lit("bundled").alias("rule"))
    return one.unionByName(two)


def precision_recall(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row: hits, precision (of what was found) and recall (of what is expected)."""
    both = found.select(*key, F.lit(1).alias("f")).join(expected.select(*key, F.lit(1).alias("e")), key, "full_outer")
    hits = F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull())
    return both.agg(hits.alias("hits"), (hits / F.count("f")).alias("precision"), (hits / F.count("e")).alias("recall"))


def bulk_operations(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, operation, change_ids, decided_at): what one bulk operation decided at once, its ids in order."""
    return log.groupBy(*by, "operation").agg(F.sort_array(F.collect_list("change_id")).alias("change_ids"), F.max("at").alias("decided_at"))


def column_counts(cells: DataFrame) -> DataFrame:
    """(table, columns): the widest row of each table, its spans added up. cells: (table, row, span)."""
    return cells.groupBy("table", "row").agg(F.sum("span").alias("n")).groupBy("table").agg(F.max("n").alias("columns"))


def within_budget(rows: DataFrame, order: list[str], group: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """rows of each group with ok: whether the group's rows so far keep within both budgets."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("ok", (F.row_number().over(w) <= most_rows) & (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= most_size))


def require_within(rows: DataFrame, most_rows: int) -> DataFrame:
    """rows, or an error if there are more than most_rows; only so many and one are looked at."""
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return rows


def expanded_sizes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, total): the size of each node with all that it includes, as often as it does. edges: (source, target), repeated ones
    count; sizes: (node, size). A cycle is an error.

    Nodes are settled from the leaves up, each once, so shared parts aren't expanded again and again. Joins are by sorting, since a broadcast in
    every round would go through the driver."""
    edges = checkpointed(edges.select("source", "target")).hint("merge")
    open_ = checkpointed(sizes.select("node", "size"))
    settled = None
    while True:
        waiting = edges.join(open_.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        ready = open_.hint("merge").join(waiting, "node", "left_anti")
        if settled is None:
            done = ready.select("node", F.col("size").alias("total"))
        else:
            parts = edges.join(settled.select(F.col("node").alias("target"), "total"), "target").groupBy(F.col("source").alias("node")).agg(F.sum("total").alias("parts"))
            done = ready.hint("merge").join(parts, "node", "left").select("node", (F.col("size") + F.coalesce("parts", F.lit(0))).alias("total"))
        done = checkpointed(done)
        if done.isEmpty():
            raise ValueError("a cycle of includes")
        settled = done if settled is None else settled.unionByName(done)
        open_ = checkpointed(open_.hint("merge").join(done.select("node"), "node", "left_anti"))
        if open_.isEmpty():
            return settled


def nested_objects(documents: DataFrame, key: str, json: str, fields: list[str]) -> DataFrame:
    """(key, fields): every object anywhere in the JSON that has exactly these fields, as strings. What lies inside one isn't searched.

    A level is read from the one above it, written, and the search ends with the first level that is empty."""
    spark = documents.sparkSession
    level, found = documents.select(key, F.parse_json(json).alias("v")), None
    while True:
        names = F.array_sort(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
        is_one = F.coalesce(names == F.array(*(F.lit(f) for f in sorted(fields))), F.lit(False))
        here = level.filter(is_one).select(key, *(F.variant_get("v", f"$.{f}", "string").alias(f) for f in fields))
        found = here if found is None else found.unionByName(here)
        inner = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("w"))
        level = checkpointed(level.filter(~is_one).lateralJoin(inner).select(key, F.col("w").alias("v")))
        if level.isEmpty():
            return found
