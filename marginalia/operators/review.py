"""Decisions on changes, eligibility, plans and the ledger.

changes: (change_id, kind, resolution, before, after, path, start, end). decisions: (change_id, decision, seq): a log in which the
last entry of a change counts and ``pending`` takes a decision back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import flagged

# What can be decided.
DECISIONS = ("accept", "reject", "defer", "manual", "conflict")
BLOCKING = ("conflict", "unmatched", "unsupported")


def fold(log: DataFrame) -> DataFrame:
    """(change_id, decision, seq): the latest entry of each change, unless it withdraws. Grouped with partial results, so a
    change with very many entries is no hot key."""
    last = log.groupBy("change_id").agg(F.max(F.struct("seq", "decision")).alias("l"))
    return last.select("change_id", F.col("l.decision").alias("decision"), F.col("l.seq").alias("seq")).filter("decision != 'pending'")


def decided(changes: DataFrame, log: DataFrame) -> DataFrame:
    return changes.join(fold(log).select("change_id", "decision"), "change_id", "left")


def summary(changes: DataFrame, log: DataFrame) -> DataFrame:
    """One row: how many changes have each decision; zeros stay."""
    d = F.col("decision")
    counts = [F.count_if(d == name).alias(name) for name in DECISIONS]
    return decided(changes, log).agg(*counts, F.count_if(d.isNull()).alias("pending"), F.count("*").alias("total"))


def safety_class() -> Column:
    """conflict before manual before safe."""
    d, r = F.coalesce("decision", F.lit("")), F.col("resolution")
    return F.when((d == "conflict") | r.isin(*BLOCKING), "conflict").when(r == "exact", "safe").otherwise("manual")


def initial_decision(kind: Column, resolution: Column) -> Column:
    return (
        F.when(resolution.isin(*BLOCKING), "conflict").when(kind.isin("comment", "structural"), "manual").when(resolution == "exact", "pending").otherwise("manual")
    )


def matching(rows: DataFrame, which: str) -> DataFrame:
    """rows: decided changes. which: all, pending, manual, comment, safe, conflict or high-risk; another name is an error."""
    conditions = {
        "all": F.lit(True),
        "pending": F.col("decision").isNull(),
        "manual": safety_class() == "manual",
        "comment": F.col("kind") == "comment",
        "safe": safety_class() == "safe",
        "conflict": safety_class() == "conflict",
        "high-risk": (F.col("resolution") != "exact") | F.col("kind").isin("structural", "move"),
    }
    if which not in conditions:
        raise ValueError(f"unknown filter: {which}")
    return rows.filter(conditions[which])


def facets(rows: DataFrame) -> DataFrame:
    c = safety_class()
    return rows.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("decision").isNull()).alias("pending"),
        F.count_if(c == "safe").alias("safe"),
        F.count_if(c == "manual").alias("manual"),
        F.count_if(c == "conflict").alias("conflict"),
    )


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """The rows of one page in a total order; a number beyond either end takes the nearest page."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def bulk_accept(changes: DataFrame, log: DataFrame) -> DataFrame:
    """What one click on "accept all safe" selects: exact and undecided."""
    return decided(changes, log).filter((F.col("resolution") == "exact") & F.col("decision").isNull()).select("change_id")


def eligibility() -> Column:
    """Code of the first rule that a change breaks, or ``eligible``."""
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    special = r"[\\{}$&#_^~%]"
    rules = [
        (F.col("decision").isNull(), "undecided"),
        (F.col("decision") != "accept", "not_accepted"),
        (F.col("resolution").isin(*BLOCKING), "unresolved"),
        (F.col("resolution") != "exact", "inexact"),
        (~F.col("kind").isin("insertion", "deletion", "replacement"), "kind"),
        ((before == "") & (after == ""), "empty"),
        (before == after, "no_change"),
        (after.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), "control_character"),
        (after.rlike(r"[\r\n]"), "line_break"),
        (before.rlike(special) | after.rlike(special), "markup"),
        (F.col("start").isNull() | (F.col("end") < F.col("start")), "range"),
    ]
    code = F.when(*rules[0])
    for condition, name in rules[1:]:
        code = code.when(condition, name)
    return code.otherwise("eligible")


def plan(changes: DataFrame, log: DataFrame) -> DataFrame:
    """changes with outcome: operation, blocked (accepted but not eligible, or overlapping another) or excluded."""
    rows = decided(changes, log).withColumn("code", eligibility())
    able = flagged(rows.filter("code = 'eligible'").withColumn("id", F.col("change_id"))).drop("id")
    joined = able.unionByName(rows.filter("code <> 'eligible'").withColumn("clash", F.lit(False)))
    code = F.when(F.col("clash"), "overlap").otherwise(F.col("code"))
    outcome = F.when(F.coalesce(F.col("decision") != "accept", F.lit(True)), "excluded").when(code == "eligible", "operation").otherwise("blocked")
    return joined.withColumn("code", code).withColumn("outcome", outcome).drop("clash")


def plan_summary(planned: DataFrame) -> DataFrame:
    """One row. A single blocked change blocks the whole plan."""
    o = F.col("outcome")
    sums = planned.agg(
        F.count_if(F.col("decision") == "accept").alias("approved"),
        F.count_if(o == "operation").alias("planned"),
        F.count_if(o == "blocked").alias("blocked"),
        F.count_if(o == "excluded").alias("excluded"),
        F.count_if(F.col("code") == "overlap").alias("overlaps"),
    )
    return sums.withColumn("status", F.when(F.col("blocked") > 0, "blocked").when(F.col("planned") == 0, "empty").otherwise("ready"))


def ledger(planned: DataFrame, applied: DataFrame) -> DataFrame:
    """(change_id, kind, decision, outcome, status) of all changes, and of applied edits that no change explains.
    applied: (change_id)."""
    done = applied.groupBy("change_id").agg(F.count("*").alias("times"))
    both = planned.join(done, "change_id", "full_outer")
    status = (
        F.when(F.col("outcome").isNull(), "unexpected")
        .when((F.col("outcome") == "operation") & (F.col("times") == 1), "applied")
        .when(F.col("times") > 1, "duplicate")
        .when((F.col("outcome") == "operation"), "missing")
        .when(F.col("times") == 1, "unapproved")
        .when(F.col("outcome") == "blocked", "blocked")
        .otherwise("not_applied")
    )
    return both.select("change_id", "kind", "decision", "outcome", status.alias("status"))


def reviewable(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """(report, reviewable): a success, or a partial export whose findings, at least one, are all recoverable warnings.

    reports: (report, status); findings: (report, severity, recoverable)."""
    fine = findings.groupBy("report").agg(F.bool_and((F.col("severity") == "warning") & F.col("recoverable")).alias("fine"))
    ok = (F.col("status") == "success") | ((F.col("status") == "partial") & F.coalesce("fine", F.lit(False)))
    return reports.join(fine, "report", "left").select("report", ok.alias("reviewable"))


def numbered(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """ordinal from 0 within each partition, with the neighbours' ids."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumns(
        {
            "ordinal": (F.row_number().over(w) - 1).cast("long"),
            "neighbours": F.array_compact(F.array(F.lag("unit_id").over(w), F.lead("unit_id").over(w))),
        }
    )
