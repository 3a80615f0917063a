"""Queries over review evidence. The driver's tables stand in: events for revision events and decision logs, documents with
their labels for changes, lineitem for byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import intervals, reconcile, review
from .registry import query, table

# The kind of revision that each event type stands for.
KINDS = {"click": "insert", "purchase": "delete", "view": "comment", "signup": "move_from", "error": "move_to"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
EVENTS_SQL = f"ev AS (SELECT event_id, user_id, ts, {_KIND_SQL} AS kind FROM events)"


def revision_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.element_at(names, F.col("event_type")).alias("kind"))


# the greedy pairing as a recursive walk: one event after the other, a pair takes two
PAIRS_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
o AS (SELECT *, row_number() OVER w AS rn, lead(kind) OVER w AS next_kind, lead(event_id) OVER w AS next_id FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, rn, event_id, next_id, (kind = 'insert' AND next_kind = 'delete' OR kind = 'delete' AND next_kind = 'insert') IS TRUE AS may FROM o),
r AS (SELECT user_id, rn, event_id, next_id, may AS pair FROM f WHERE rn = 1 UNION ALL
      SELECT f.user_id, f.rn, f.event_id, f.next_id, f.may AND NOT r.pair FROM r JOIN f ON f.user_id = r.user_id AND f.rn = r.rn + 1)
SELECT user_id, event_id, next_id FROM r WHERE pair"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    ev = revision_events(spark, sf)
    may = F.array_sort(F.array("kind", "next.kind")) == F.array(F.lit("delete"), F.lit("insert"))
    return E.adjacent_pairs(ev, ["user_id"], ["ts", "event_id"], may)


@query(PAIRS_SQL)
def event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """An insertion next to a deletion of the same author becomes one replacement."""
    return pairs(spark, sf).filter("pair_start").select("user_id", "event_id", F.col("next.event_id").alias("next_id"))


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count_if(kind = 'move_from') AS a, count_if(kind = 'move_to') AS b,
      min(event_id) FILTER (kind = 'move_from') AS x, min(event_id) FILTER (kind = 'move_to') AS y FROM ev WHERE kind LIKE 'move%' GROUP BY ALL)
    SELECT user_id, day, CASE WHEN a = 1 AND b = 1 THEN 'paired' ELSE 'conflict' END AS status, CASE WHEN a = 1 AND b = 1 THEN x END AS from_id,
           CASE WHEN a = 1 AND b = 1 THEN y END AS to_id FROM s"""
)
def move_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    return E.move_pairs(revision_events(spark, sf).withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"])


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, CAST(ts AS DATE) AS day, list(kind ORDER BY ts, event_id) AS k FROM ev GROUP BY ALL)
    SELECT shape, count(*) AS n FROM (SELECT CASE WHEN k = ['insert'] THEN 'insertion' WHEN k = ['delete'] THEN 'deletion'
      WHEN list_sort(k) = ['delete', 'insert'] THEN 'replacement' WHEN list_sort(k) = ['move_from', 'move_to'] THEN 'move'
      WHEN k = ['comment'] THEN 'comment' ELSE 'structural' END AS shape FROM g) GROUP BY shape"""
)
def change_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The events of one author and day as one change."""
    ev = revision_events(spark, sf).withColumn("day", F.to_date("ts"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind"))), lambda x: x["kind"])
    grouped = ev.groupBy("user_id", "day").agg(kinds.alias("k"))
    return grouped.groupBy(E.change_shape(F.col("k")).alias("shape")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {EVENTS_SQL} SELECT kind, count(*) AS n, CAST(count_if(user_id % 7 = 0) AS BIGINT) AS unmatched, min(event_id) AS first_id FROM ev GROUP BY kind"""
)
def change_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A2, A9."""
    return revision_events(spark, sf).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("user_id") % 7 == 0).alias("unmatched"), F.min("event_id").alias("first_id")
    )


@query("SELECT user_id, row_number() OVER (ORDER BY min((ts, event_id))) AS rank FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def authors_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return E.first_seen(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


@query(
    """SELECT a.user_id, a.event_type, a.event_id AS first_id, b.event_id AS last_id FROM
    (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) a JOIN
    (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) b USING (user_id, event_type)"""
)
def diagnostics_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Keep the first and keep the last of a key, in one grouping."""
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b")
    )
    return rows.select("user_id", "event_type", F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("last_id"))


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def top_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 latest."""
    return table(spark, sf, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query(
    """SELECT event_id, user_id, value FROM (SELECT e.event_id, e.user_id, d.event_id AS value, row_number() OVER (PARTITION BY e.event_id ORDER BY d.ts DESC, d.event_id DESC) AS k
    FROM (SELECT * FROM events WHERE event_type <> 'signup') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') d ON e.user_id = d.user_id AND d.ts <= e.ts) WHERE k = 1"""
)
def directive_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The latest directive before each command of its file."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    set_ = ev.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("value"))
    return E.as_of(ev.filter("event_type <> 'signup'"), set_, "user_id", "ts", "value").select("event_id", "user_id", "value")


# Changes: one for each document; its text's first words stand for what is replaced, its last for the replacement.
CHANGES_SQL = """ch AS (SELECT doc_id AS change_id, CASE doc_id % 5 WHEN 0 THEN 'insertion' WHEN 1 THEN 'deletion' WHEN 2 THEN 'replacement' WHEN 3 THEN 'comment' ELSE 'replacement' END AS kind,
  CASE WHEN doc_id % 11 = 0 THEN 'conflict' WHEN doc_id % 13 = 0 THEN 'unmatched' WHEN doc_id % 7 = 0 THEN 'normalised' ELSE 'exact' END AS resolution,
  left(text, 20) AS before, right(text, 20) AS after, source AS path, doc_id % 1000 * 30 AS start, doc_id % 1000 * 30 + n_chars % 40 AS "end" FROM documents),
lg AS (SELECT doc_id AS change_id, CASE WHEN quality = 1 THEN 'accept' WHEN toxic = 1 THEN 'reject' ELSE 'defer' END AS decision, 1 AS seq FROM labels
  UNION ALL SELECT doc_id, 'pending', 2 FROM labels WHERE doc_id % 17 = 0),
fo AS (SELECT change_id, decision, seq FROM (SELECT change_id, max({'seq': seq, 'decision': decision}) AS l FROM lg GROUP BY 1), LATERAL (SELECT l.decision AS decision, l.seq AS seq) WHERE decision <> 'pending'),
de AS (SELECT ch.*, decision, CASE WHEN decision = 'conflict' OR resolution IN ('conflict', 'unmatched', 'unsupported') THEN 'conflict' WHEN resolution = 'exact' THEN 'safe' ELSE 'manual' END AS cls
  FROM ch LEFT JOIN fo USING (change_id))"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "insertion").when(i % 5 == 1, "deletion").when(i % 5 == 3, "comment").otherwise("replacement")
    resolution = F.when(i % 11 == 0, "conflict").when(i % 13 == 0, "unmatched").when(i % 7 == 0, "normalised").otherwise("exact")
    start = i % 1000 * 30
    return table(spark, sf, "documents").select(
        i.alias("change_id"), kind.alias("kind"), resolution.alias("resolution"), F.substring("text", 1, 20).alias("before"), F.expr("right(text, 20)").alias("after"),
        F.col("source").alias("path"), start.alias("start"), (start + F.col("n_chars") % 40).alias("end"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels")
    first = d.select(F.col("doc_id").alias("change_id"), F.when(F.col("quality") == 1, "accept").when(F.col("toxic") == 1, "reject").otherwise("defer").alias("decision"), F.lit(1).alias("seq"))
    taken_back = d.filter("doc_id % 17 = 0").select(F.col("doc_id").alias("change_id"), F.lit("pending").alias("decision"), F.lit(2).alias("seq"))
    return first.unionByName(taken_back)


@query(f"WITH {CHANGES_SQL} SELECT * FROM fo")
def decision_fold(spark: SparkSession, sf: str) -> DataFrame:
    """P5, W10."""
    return review.fold(log(spark, sf))


@query(
    f"WITH {CHANGES_SQL} SELECT " + ", ".join(f"CAST(count_if(decision = '{d}') AS BIGINT) AS {d}" for d in review.DECISIONS)
    + ", CAST(count_if(decision IS NULL) AS BIGINT) AS pending, count(*) AS total FROM de"
)
def decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A3, U3."""
    return review.summary(changes(spark, sf), log(spark, sf))


@query(f"""WITH {CHANGES_SQL} SELECT count(*) AS "all", CAST(count_if(decision IS NULL) AS BIGINT) AS pending, CAST(count_if(cls = 'safe') AS BIGINT) AS safe,
    CAST(count_if(cls = 'manual') AS BIGINT) AS manual, CAST(count_if(cls = 'conflict') AS BIGINT) AS conflict FROM de""")
def approval_facets(spark: SparkSession, sf: str) -> DataFrame:
    """F2, F3."""
    return review.facets(review.decided(changes(spark, sf), log(spark, sf)))


@query(f"""WITH {CHANGES_SQL} SELECT 'pending' AS filter, change_id FROM de WHERE decision IS NULL UNION ALL SELECT 'manual', change_id FROM de WHERE cls = 'manual'
    UNION ALL SELECT 'high-risk', change_id FROM de WHERE resolution <> 'exact'""")
def approval_filters(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    rows, out = review.decided(changes(spark, sf), log(spark, sf)), None
    for which in ("pending", "manual", "high-risk"):
        got = review.matching(rows, which).select(F.lit(which).alias("filter"), "change_id")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {CHANGES_SQL} SELECT change_id, decision FROM de WHERE decision IS NULL ORDER BY change_id LIMIT 25 OFFSET 50")
def approval_page(spark: SparkSession, sf: str) -> DataFrame:
    """L2: the third page of 25."""
    rows = review.matching(review.decided(changes(spark, sf), log(spark, sf)), "pending").select("change_id", "decision")
    return review.page(rows, ["change_id"], 3, 25)


@query(f"WITH {CHANGES_SQL} SELECT change_id FROM de WHERE resolution = 'exact' AND decision IS NULL")
def bulk_accept_safe_selection(spark: SparkSession, sf: str) -> DataFrame:
    """P5."""
    return review.bulk_accept(changes(spark, sf), log(spark, sf))


ELIGIBLE_SQL = r"""el AS (SELECT *, CASE WHEN decision IS NULL THEN 'undecided' WHEN decision <> 'accept' THEN 'not_accepted'
  WHEN resolution IN ('conflict', 'unmatched', 'unsupported') THEN 'unresolved' WHEN resolution <> 'exact' THEN 'inexact'
  WHEN kind NOT IN ('insertion', 'deletion', 'replacement') THEN 'kind' WHEN coalesce(before, '') = '' AND coalesce(after, '') = '' THEN 'empty' WHEN before = after THEN 'no_change'
  WHEN regexp_matches(after, '[\x00-\x08\x0b-\x1f\x7f]') THEN 'control_character' WHEN regexp_matches(after, '[\r\n]') THEN 'line_break'
  WHEN regexp_matches(before, '[\\{}$&#_^~%]') OR regexp_matches(after, '[\\{}$&#_^~%]') THEN 'markup' WHEN start IS NULL OR "end" < start THEN 'range' ELSE 'eligible' END AS code FROM de),
hi AS (SELECT * FROM el WHERE code = 'eligible'),
cl AS (SELECT DISTINCT a.change_id FROM hi a JOIN hi b ON a.path = b.path AND a.change_id <> b.change_id AND CASE
  WHEN a.start = a."end" AND b.start = b."end" THEN a.start = b.start WHEN a.start = a."end" THEN b.start <= a.start AND a.start < b."end"
  WHEN b.start = b."end" THEN a.start <= b.start AND b.start < a."end" ELSE greatest(a.start, b.start) < least(a."end", b."end") END),
pl AS (SELECT * EXCLUDE (code), CASE WHEN change_id IN (FROM cl) THEN 'overlap' ELSE code END AS code,
  CASE WHEN decision IS DISTINCT FROM 'accept' THEN 'excluded' WHEN code = 'eligible' AND change_id NOT IN (FROM cl) THEN 'operation' ELSE 'blocked' END AS outcome FROM el)"""


@query(f"WITH {CHANGES_SQL}, {ELIGIBLE_SQL} SELECT change_id, code FROM el")
def patch_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """F5, F6."""
    return review.decided(changes(spark, sf), log(spark, sf)).select("change_id", review.eligibility().alias("code"))


def planned(spark: SparkSession, sf: str) -> DataFrame:
    return review.plan(changes(spark, sf), log(spark, sf))


@query(f"WITH {CHANGES_SQL}, {ELIGIBLE_SQL} SELECT change_id, code, outcome FROM pl")
def plan_partition(spark: SparkSession, sf: str) -> DataFrame:
    """P6."""
    return planned(spark, sf).select("change_id", "code", "outcome")


@query(f"""WITH {CHANGES_SQL}, {ELIGIBLE_SQL}, s AS (SELECT CAST(count_if(decision = 'accept') AS BIGINT) AS approved, CAST(count_if(outcome = 'operation') AS BIGINT) AS planned,
    CAST(count_if(outcome = 'blocked') AS BIGINT) AS blocked, CAST(count_if(outcome = 'excluded') AS BIGINT) AS excluded, CAST(count_if(code = 'overlap') AS BIGINT) AS overlaps FROM pl)
    SELECT *, CASE WHEN blocked > 0 THEN 'blocked' WHEN planned = 0 THEN 'empty' ELSE 'ready' END AS status FROM s""")
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A5: one blocked change blocks the plan."""
    return review.plan_summary(planned(spark, sf))


@query(f"""WITH {CHANGES_SQL}, {ELIGIBLE_SQL}, ap AS (SELECT change_id, count(*) AS times FROM (SELECT doc_id AS change_id FROM documents WHERE doc_id % 3 > 0
      UNION ALL SELECT doc_id FROM documents WHERE doc_id % 19 = 0 UNION ALL SELECT -doc_id - 1 FROM documents WHERE doc_id % 101 = 0) GROUP BY 1)
    SELECT change_id, kind, decision, outcome, CASE WHEN outcome IS NULL THEN 'unexpected' WHEN outcome = 'operation' AND times = 1 THEN 'applied' WHEN times > 1 THEN 'duplicate'
      WHEN outcome = 'operation' THEN 'missing' WHEN times = 1 THEN 'unapproved' WHEN outcome = 'blocked' THEN 'blocked' ELSE 'not_applied' END AS status FROM pl FULL JOIN ap USING (change_id)""")
def ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The plan against edits of which some are missing, doubled or unexpected."""
    i = table(spark, sf, "documents").select("doc_id")
    applied = i.filter("doc_id % 3 > 0").unionByName(i.filter("doc_id % 19 = 0")).union(i.filter("doc_id % 101 = 0").select(-F.col("doc_id") - 1))
    return review.ledger(planned(spark, sf), applied.withColumnRenamed("doc_id", "change_id"))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as ranges; every ninth is empty."""
    start = F.col("l_linenumber").cast("long") * 10
    size = F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(F.col("l_quantity").cast("long") % 15)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"), F.xxhash64("*").alias("id"), start.alias("start"), (start + size).alias("end")
    )


RANGES_SQL = """rg AS (SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS line, l_linenumber * 10 AS start, l_linenumber * 10 + CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE CAST(trunc(l_quantity) AS BIGINT) % 15 END AS "end",
  row_number() OVER () AS id FROM lineitem)"""
_ZERO = """CASE WHEN a.start = a."end" AND b.start = b."end" THEN a.start = b.start WHEN a.start = a."end" THEN b.start <= a.start AND a.start < b."end"
  WHEN b.start = b."end" THEN a.start <= b.start AND b.start < a."end" ELSE greatest(a.start, b.start) < least(a."end", b."end") END"""


def _overlap_sql(condition: str) -> str:
    return f"WITH {RANGES_SQL} SELECT a.path, count(*) AS n FROM rg a JOIN rg b ON a.path = b.path AND a.id < b.id AND ({condition}) GROUP BY a.path"


@query(_overlap_sql(_ZERO))
def overlap_pairs_zero_width_aware(spark: SparkSession, sf: str) -> DataFrame:
    """J12."""
    return intervals.overlap_pairs(ranges(spark, sf)).groupBy("path").agg(F.count("*").alias("n"))


@query(_overlap_sql('greatest(a.start, b.start) < least(a."end", b."end")'))
def overlap_pairs_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Empty ranges never clash."""
    return intervals.overlap_pairs(ranges(spark, sf), zero_width=False).groupBy("path").agg(F.count("*").alias("n"))


@query(
    f"""WITH {RANGES_SQL} SELECT path, line, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM rg a WHERE NOT EXISTS (
    SELECT 1 FROM rg b WHERE a.path = b.path AND a.id <> b.id AND greatest(a.start, b.start) < least(a."end", b."end"))"""
)
def non_overlapping_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """J14."""
    return intervals.survivors(ranges(spark, sf)).select("path", "line", "start", "end")


@query(
    f"""WITH {RANGES_SQL} SELECT path, line FROM rg a WHERE line % 2 = 1 AND NOT EXISTS (SELECT 1 FROM rg b WHERE b.line % 2 = 0 AND a.path = b.path
    AND greatest(a.start, b.start) < least(a."end", b."end"))"""
)
def islands_outside_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """J15."""
    rows = ranges(spark, sf)
    return intervals.outside(rows.filter("line % 2 = 1"), rows.filter("line % 2 = 0")).select("path", "line")


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('x') ELSE sha256(text) END AS h
    FROM documents WHERE doc_id % 10 <> 4)
    SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (doc_id)"""
)
def full_outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    """A tree against a copy of it in which files are missing, new or changed."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    other = d.filter("doc_id % 10 <> 4").withColumn("h", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit(b"x"), 256)).otherwise(F.col("h")))
    return reconcile.differences(d.filter("doc_id % 10 <> 3"), other, ["doc_id"], ["h"])


@query(
    """WITH f AS (SELECT doc_id, text FROM documents WHERE doc_id % 6 > 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 15 = 1),
    s AS (SELECT doc_id, count(*) AS n, min(CASE WHEN doc_id % 8 = 1 THEN '' ELSE text END) AS seen FROM f GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN seen = text THEN 'ok' ELSE 'changed' END AS status FROM documents LEFT JOIN s USING (doc_id)"""
)
def expected_key_audit(spark: SparkSession, sf: str) -> DataFrame:
    """J10, J18."""
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("text"))
    found = d.filter("doc_id % 6 > 0").unionByName(d.filter("doc_id % 15 = 1")).withColumn("text", F.when(F.col("doc_id") % 8 == 1, 0).otherwise(F.col("text")))
    return reconcile.expected_keys(d, found, "doc_id", "text")


@query(
    """SELECT id AS doc_id, CAST(n AS BIGINT) AS n, known FROM (SELECT id, sum(p) AS n, bool_or(k) AS known FROM (SELECT doc_id AS id, 0 AS p, true AS k FROM documents
      UNION ALL SELECT doc_id, 1, false FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1, false FROM labels WHERE toxic = 1) GROUP BY id) WHERE n <> 1 OR NOT known"""
)
def partition_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that aren't in exactly one of two label sets."""
    l = table(spark, sf, "labels")  # noqa: E741
    parts = {"quality": l.filter("quality = 1"), "toxic": l.filter("toxic = 1")}
    return reconcile.partition_check(table(spark, sf, "documents").select("doc_id"), parts, "doc_id")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS source, p_partkey * 2 + k AS target FROM part, unnest([1, 2]) AS u(k) WHERE p_partkey % 7 > 0),
    r AS (SELECT 1 AS node, 0 AS depth UNION ALL SELECT target, depth + 1 FROM r JOIN e ON source = node)
    SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""
)
def dependency_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All that part 1 leads to, where part k includes 2k+1 and 2k+2 unless 7 divides k."""
    parts = table(spark, sf, "part").filter("p_partkey % 7 > 0")
    edges = parts.select(F.col("p_partkey").alias("source"), F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 2 + 2)).alias("target"))
    return reconcile.closure(edges, spark.createDataFrame([(1,)], "node long"))


@query(
    """WITH e AS (SELECT p_brand, p_partkey, p_size, 1000 * p_size / sum(p_size) OVER (PARTITION BY p_brand) AS x FROM part),
    f AS (SELECT *, floor(x) AS s FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x - s DESC, p_partkey) AS k, 1000 - sum(s) OVER (PARTITION BY p_brand) AS l FROM f)
    SELECT p_brand, p_partkey, CAST(s + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM r"""
)
def apportion_widths(spark: SparkSession, sf: str) -> DataFrame:
    """The parts' sizes as thousandths of their brand's."""
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return reconcile.apportion(rows, ["p_brand"], "p_size", 1000, "p_partkey").select("p_brand", "p_partkey", "share")


@query(
    """WITH t AS (SELECT doc_id, text, octet_length(encode(left(text, 3))) AS a, octet_length(encode(left(text, 6))) AS b FROM documents WHERE length(text) >= 12)
    SELECT doc_id AS path, left(text, 3) || '<' || doc_id || '>' || substring(text, 7, 3) || substring(text, 10) || '!' AS text FROM t
    UNION ALL SELECT doc_id, text FROM documents WHERE length(text) < 12 OR text IS NULL"""
)
def splice_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Characters 4 to 6 are replaced and a mark is added at the end, in byte ranges."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    long = d.filter(F.length("text") >= 12)
    octets = lambda n: F.octet_length(F.substring("text", 1, n))
    inner = long.select("path", octets(3).alias("start"), octets(6).alias("end"), F.concat(F.lit("<"), "path", F.lit(">")).alias("replacement"))
    end = long.select("path", F.octet_length("text").alias("start"), F.octet_length("text").alias("end"), F.lit("!").alias("replacement"))
    return intervals.splice(d, inner.unionByName(end))
