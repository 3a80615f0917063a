"""Validators over the stand-in tables, and the batch form of the streamed decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget, validate
from ..streaming import decisions
from . import evidence
from .registry import query, table


@query(
    f"""WITH {evidence.CHANGES_SQL} SELECT CAST(change_id AS VARCHAR) AS key, 'final_is_complete' AS rule FROM de WHERE decision IS NULL"""
)
def approval_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V8: what keeps the set of decisions from being final."""
    return validate.approval_set(evidence.review.decided(evidence.changes(spark, sf), evidence.log(spark, sf)), final=True)


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS key, 'range' AS rule FROM lineitem WHERE l_quantity > 45
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'unique_id' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"""
)
def plan_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V9: order keys as operation ids, and large quantities as ranges that end before they start."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    ranges = {"range": F.col("l_quantity") <= 45}
    return validate.all_of(validate.broken(rows, "id", ranges), validate._named(validate.repeated(rows, ["id"]), "id", "unique_id"))


@query(
    """SELECT user_id AS change_id, event_type AS decision FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def current_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """P5 over a log of events, as the streamed form leaves it."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("change_id"), F.col("event_type").alias("decision"), "ts", "event_id")
    return decisions.current(ev)


_BUDGETS = ((50, 10**12), (10**9, 400_000), (120, 300_000), (10**9, 10**15), (0, 10), (10**9, 0))


@query(
    f"""WITH b AS (SELECT * FROM (VALUES {", ".join(map(str, _BUDGETS))}) AS t(most_rows, most_bytes)),
    s AS (SELECT doc_id, row_number() OVER w AS n, sum(octet_length(encode(text))) OVER w AS b, octet_length(encode(text)) AS size FROM documents WINDOW w AS (ORDER BY doc_id)),
    o AS (SELECT most_rows, most_bytes, min_by({{'n': n, 'b': b, 'size': size, 'doc_id': doc_id}}, n) AS r FROM b LEFT JOIN s ON n > most_rows OR s.b > most_bytes GROUP BY ALL)
    SELECT CAST(most_rows AS BIGINT) AS most_rows, CAST(most_bytes AS BIGINT) AS most_bytes, CAST(coalesce(r.n - 1, (SELECT count(*) FROM documents)) AS BIGINT) AS n_rows,
      CAST(coalesce(r.b - r.size, (SELECT sum(octet_length(encode(text))) FROM documents)) AS BIGINT) AS n_bytes, CASE WHEN r.n > most_rows THEN 'rows' WHEN r.n IS NOT NULL THEN 'bytes' END AS "limit", r.doc_id AS doc_id FROM o"""
)
def scan_budget(spark: SparkSession, sf: str) -> DataFrame:
    """How far budgets of rows and bytes reach over all documents, and the first one beyond."""
    rows = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return budget.reach(rows, ["doc_id"], "size", list(_BUDGETS))
