"""Constraints as queries: each function gives the rows that break a rule, with its name. No row: the evidence is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import not_increasing
from .intervals import contiguity_violations, flagged
from .reconcile import repeated


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks. A rule that gives null is broken."""
    each = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(each)).alias("rule"))


def _named(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_manifest(runs: DataFrame) -> DataFrame:
    """V1: only the first revision has no predecessor."""
    return broken(runs, "run_id", {"first_has_no_previous": (F.col("revision") == 1) == F.col("previous").isNull(), "revision": F.col("revision") >= 1})


def source_manifest(files: DataFrame, main: str) -> DataFrame:
    """Unique paths, in order, the main file among them. files: (path, ix)."""
    ordered = not_increasing(files.withColumn("all", F.lit(1)), ["all"], ["ix"], "path")
    absent = files.agg(F.count_if(F.col("path") == main).alias("n")).filter("n != 1").select(F.lit(main).alias("path"))
    return all_of(_named(repeated(files, ["path"]), "path", "unique_path"), _named(ordered, "path", "sorted"), _named(absent, "path", "main_present"))


def review_units(units: DataFrame) -> DataFrame:
    """V3: unique ids and strictly increasing ordinals within a path."""
    return all_of(_named(repeated(units, ["unit_id"]), "unit_id", "unique_id"), _named(not_increasing(units, ["path"], ["start"], "ordinal"), "unit_id", "increasing"))


def source_map(segments: DataFrame) -> DataFrame:
    """V4: contiguous; patchable exactly where the mapping is the identity."""
    rules = {"identity_is_patchable": (F.col("kind") == "identity") == F.col("patchable"), "range": F.col("start") <= F.col("end")}
    return all_of(_named(contiguity_violations(segments), "path", "contiguous"), broken(segments, "path", rules))


def export_reports(reports: DataFrame) -> DataFrame:
    """V5: a success has its review units, its map and its document; what hasn't failed has its document."""
    rules = {"success_is_bound": (F.col("status") != "success") | (F.col("source_map").isNotNull() & F.col("review_ir").isNotNull()), "has_document": (F.col("status") == "failed") | F.col("document").isNotNull()}
    return broken(reports, "report_id", rules)


def raw_events(events: DataFrame) -> DataFrame:
    """V6."""
    rules = {"deletion_has_text": (F.col("kind") != "delete") | (F.length("text") > 0), "id": F.col("event_id").isNotNull()}
    return all_of(broken(events, "event_id", rules), _named(repeated(events, ["part", "kind", "native_id"]), "native_id", "unique_native_id"))


def change_set(changes: DataFrame, events: DataFrame) -> DataFrame:
    """V7: unique ids, every raw event known, safe only where exact. changes: (change_id, raw_event_ids, safety, resolution)."""
    used = changes.select("change_id", F.explode("raw_event_ids").alias("event_id"))
    unknown = used.join(events.select("event_id"), "event_id", "left_anti")
    rules = {"has_events": F.size("raw_event_ids") > 0, "safe_is_exact": (F.col("safety") != "safe") | (F.col("resolution") == "exact")}
    return all_of(_named(repeated(changes, ["change_id"]), "change_id", "unique_id"), _named(unknown, "change_id", "known_events"), broken(changes, "change_id", rules))


def approval_set(decided: DataFrame, final: bool) -> DataFrame:
    """V8: each change once; a final set leaves none undecided."""
    open_ = decided.filter(F.col("decision").isNull() & F.lit(final))
    return all_of(_named(repeated(decided, ["change_id"]), "change_id", "decided_once"), _named(open_, "change_id", "final_is_complete"))


def patch_plan(operations: DataFrame) -> DataFrame:
    """V9: unique ids, sound ranges, no overlap. operations: (path, id, start, end)."""
    sound = operations.filter(F.col("start") <= F.col("end"))
    clash = flagged(sound, zero_width=False).filter("clash").select("id")
    return all_of(_named(repeated(operations, ["id"]), "id", "unique_id"), _named(clash, "id", "no_overlap"), broken(operations, "id", {"range": (F.col("start") >= 0) & (F.col("start") <= F.col("end"))}))


def verification(reports: DataFrame) -> DataFrame:
    """A pass means that nothing changed that shouldn't have, and nothing is missing."""
    ok = (F.col("before") == F.col("after")) & (F.col("missing") + F.col("extra") + F.col("duplicate") == 0)
    return broken(reports, "report_id", {"pass_is_clean": (F.col("status") != "pass") | ok})


def bindings(downstream: DataFrame, upstream: DataFrame) -> DataFrame:
    """What a later object says of an earlier one's hash is that hash. (object_id, bound_hash) against (object_id, hash)."""
    joined = downstream.join(upstream, "object_id", "left")
    return _named(joined.filter(~F.col("bound_hash").eqNullSafe(F.col("hash"))), "object_id", "bound_hash")


def require_none(violations: DataFrame) -> None:
    """Fails with the first broken rule, by key and name, if there is one."""
    first = violations.orderBy("key", "rule").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['rule']}: {first[0]['key']}")
