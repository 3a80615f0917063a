"""Queries that join, order and check review evidence. The stand-ins are those of ``evidence``; what is broken in them is planted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import events as E
from ..operators import evidence as V
from ..operators import intervals, reconcile, validate
from . import evidence
from .registry import query, table


@query(
    """WITH c AS (SELECT doc_id AS change_id, CASE WHEN doc_id % 4 > 0 THEN 'u' || doc_id % 60 END AS bookmark FROM documents), b AS (SELECT 'u' || item_id AS bookmark, 'unit-' || item_id AS unit_id FROM benchmark)
    SELECT change_id, unit_id FROM c LEFT JOIN b USING (bookmark)"""
)
def change_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Changes with the unit of their bookmark; those without a bookmark, or with an unbound one, have none."""
    i = F.col("doc_id")
    changes = table(spark, sf, "documents").select(i.alias("change_id"), F.when(i % 4 > 0, F.concat(F.lit("u"), i % 60)).alias("bookmark"))
    bindings = table(spark, sf, "benchmark").select(F.concat(F.lit("u"), "item_id").alias("bookmark"), F.concat(F.lit("unit-"), "item_id").alias("unit_id"))
    return V.bound(changes, bindings, "bookmark").select("change_id", "unit_id")


@query(
    """WITH d AS (SELECT doc_id AS change_id, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE sha256(text) END AS f, CASE WHEN doc_id % 14 = 1 THEN -1 ELSE doc_id END AS position FROM documents WHERE doc_id % 8 > 0
      UNION ALL SELECT doc_id, sha256(text), doc_id FROM documents WHERE doc_id % 15 = 2 UNION ALL SELECT -doc_id - 1, 'y', 0 FROM documents WHERE doc_id % 40 = 0),
    g AS (SELECT change_id, count(*) AS n, min(position) AS pos, min(f) AS f FROM d GROUP BY 1), c AS (SELECT doc_id AS change_id, doc_id AS position, sha256(text) AS own FROM documents)
    SELECT change_id, CASE WHEN n IS NULL THEN 'missing' WHEN own IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN pos <> position THEN 'order' WHEN f <> own THEN 'fingerprint' ELSE 'ok' END AS status FROM c FULL JOIN g USING (change_id)"""
)
def decision_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every change is decided once, in its place, over what it was."""
    i = F.col("change_id")
    changes = table(spark, sf, "documents").select(F.col("doc_id").alias("change_id"), F.col("doc_id").alias("position"), F.sha2(T.utf8(F.col("text")), 256).alias("fingerprint"))
    decided = changes.filter(i % 8 > 0).withColumns({"fingerprint": F.when(i % 6 == 0, "x").otherwise(F.col("fingerprint")), "position": F.when(i % 14 == 1, -1).otherwise(i)})
    more = changes.filter(i % 15 == 2).unionByName(changes.filter(i % 40 == 0).select((-i - 1).alias("change_id"), F.lit(0).cast("long").alias("position"), F.lit("y").alias("fingerprint")))
    return V.matched(changes, decided.unionByName(more))


@query(
    """WITH c AS (SELECT user_id AS change_id, unnest([e1, e1 + 1, e2, CASE WHEN user_id % 3 = 0 THEN -1 ELSE e2 END]) AS event_id, unnest([0, 1, 2, 3]) AS pos FROM (SELECT user_id, min(event_id) AS e1, max(event_id) AS e2 FROM events GROUP BY 1))
    SELECT change_id, coalesce(string_agg(event_type, ',' ORDER BY pos) FILTER (e.event_id IS NOT NULL), '') AS kinds, count(*) FILTER (e.event_id IS NULL) AS missing FROM c LEFT JOIN events e USING (event_id) GROUP BY 1"""
)
def change_events(spark: SparkSession, sf: str) -> DataFrame:
    """The raw events of a change, by an array of ids, in its order."""
    ev = table(spark, sf, "events")
    last = F.col("e2")
    ids = F.array(F.col("e1"), F.col("e1") + 1, last, F.when(F.col("user_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(last))
    changes = ev.groupBy("user_id").agg(F.min("event_id").alias("e1"), F.max("event_id").alias("e2")).select(F.col("user_id").alias("change_id"), ids.alias("raw_event_ids"))
    return V.with_events(changes, ev, F.col("event_type")).select("change_id", F.array_join("values", ",").alias("kinds"), "missing")


@query(
    """WITH c AS (SELECT doc_id AS change_id, CASE WHEN doc_id % 5 > 0 THEN doc_id // 3 END AS unit_id FROM documents), d AS (SELECT event_id AS diagnostic_id, user_id AS c, event_id AS u FROM events WHERE event_type = 'error')
    SELECT change_id, count(DISTINCT diagnostic_id) AS n, min(diagnostic_id) AS first_id FROM c JOIN d ON d.c = change_id OR unit_id IS NOT NULL AND d.u = unit_id GROUP BY 1"""
)
def change_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics that name a change or its unit, each once."""
    i = F.col("doc_id")
    changes = table(spark, sf, "documents").select(i.alias("change_id"), F.when(i % 5 > 0, F.floor(i / 3)).alias("unit_id"))
    diagnostics = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("diagnostic_id"), F.col("user_id").alias("change_id"), F.col("event_id").alias("unit_id"))
    return V.with_diagnostics(changes, diagnostics).groupBy("change_id").agg(F.count("*").alias("n"), F.min("diagnostic_id").alias("first_id"))


@query(
    """WITH f AS (SELECT doc_id AS path, source AS role, n_chars AS size, sha256(text) AS s FROM documents), a AS (SELECT path, role, CASE WHEN path % 9 = 0 THEN size + 1 ELSE size END AS size, s, path AS artifact_id FROM f WHERE path % 5 > 0
      UNION ALL SELECT path, role, size, s, -path FROM f WHERE path % 11 = 3), g AS (SELECT path, role, size, s, count(DISTINCT artifact_id) AS n, min(artifact_id) AS a FROM a GROUP BY ALL)
    SELECT path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN a END AS artifact_id FROM f LEFT JOIN g USING (path, role, size, s)"""
)
def artifact_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """The one artifact that has a file's path, role, size and hash."""
    i = F.col("path")
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("role"), F.col("n_chars").alias("size"), F.sha2(T.utf8(F.col("text")), 256).alias("sha256"))
    one = files.filter(i % 5 > 0).withColumns({"size": F.when(i % 9 == 0, F.col("size") + 1).otherwise(F.col("size")), "artifact_id": i})
    return V.selected_artifacts(files, one.unionByName(files.filter(i % 11 == 3).withColumn("artifact_id", -i)))


@query(
    """SELECT doc_id AS entry, 'authorised' AS rule FROM documents WHERE doc_id % 50 NOT IN (SELECT item_id FROM benchmark) UNION ALL
    SELECT doc_id, 'bundled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def bundle_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose binding isn't authorised, and whose document isn't bundled."""
    entries = table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), (F.col("doc_id") % 50).alias("binding"), F.col("doc_id").alias("document"))
    return V.unauthorised(entries, table(spark, sf, "benchmark").select(F.col("item_id").alias("binding")), table(spark, sf, "labels").select(F.col("doc_id").alias("document")))


@query("SELECT doc_id AS path, l.doc_id IS NOT NULL AS discovered FROM documents LEFT JOIN labels l USING (doc_id)")
def discovered_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Target paths that the discovery has seen."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), F.lit(True).alias("known"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path")).join(known, "path", "left").select("path", F.col("known").isNotNull().alias("discovered"))


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages), n AS (SELECT DISTINCT lower(regexp_extract(html, 'href="/([^"]*)"', 1)) AS name FROM pages WHERE page_id % 3 = 0)
    SELECT page_id, count(*) AS unresolved FROM t WHERE lower(target) NOT IN (SELECT name FROM n) GROUP BY 1"""
)
def unresolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose target, in any case, no name has."""
    pages = table(spark, sf, "pages")
    targets = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target")).withColumn("name", F.lower("target"))
    names = pages.filter("page_id % 3 = 0").select(F.lower(F.regexp_extract("html", 'href="/([^"]*)"', 1)).alias("name")).distinct()
    return targets.join(names, "name", "left_anti").groupBy("page_id").agg(F.count("*").alias("unresolved"))


@query(
    """WITH f AS (SELECT doc_id FROM documents WHERE n_chars > 500), e AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT f.doc_id AS a, e.doc_id AS b FROM f FULL JOIN e ON f.doc_id = e.doc_id)
    SELECT CAST(count_if(a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS hits, count_if(a IS NOT NULL AND b IS NOT NULL) / count(a) AS precision, count_if(a IS NOT NULL AND b IS NOT NULL) / count(b) AS recall FROM b"""
)
def extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A19."""
    return V.precision_recall(table(spark, sf, "documents").filter("n_chars > 500").select("doc_id"), table(spark, sf, "labels").filter("quality = 1").select("doc_id"), ["doc_id"])


@query(
    """SELECT user_id, event_type AS operation, string_agg(event_id, ',' ORDER BY event_id) AS change_ids, max(event_id) AS decided_at FROM events WHERE event_type <> 'view' GROUP BY ALL"""
)
def bulk_operations(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    log = table(spark, sf, "events").filter("event_type <> 'view'").select("user_id", F.col("event_type").alias("operation"), F.col("event_id").alias("change_id"), F.col("event_id").alias("at"))
    return V.bulk_operations(log, ["user_id"]).select("user_id", "operation", F.array_join("change_ids", ",").alias("change_ids"), "decided_at")


@query("SELECT l_suppkey AS \"table\", CAST(max(n) AS BIGINT) AS columns FROM (SELECT l_suppkey, l_orderkey, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A16."""
    return V.column_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("span")))


@query("SELECT event_id, user_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value <= p")
def unordered_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that don't lie above the one before."""
    return E.not_increasing(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE o_totalprice < p")
def progress_regressions(spark: SparkSession, sf: str) -> DataFrame:
    """Progress that falls."""
    return E.not_increasing(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice", strict=False).select("o_orderkey", "o_custkey")


@query(
    """SELECT user_id, day FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list(event_type = 'click' ORDER BY event_id) AS l FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) WHERE l <> [true, false]"""
)
def unbalanced_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose markers aren't one opening and then one closing."""
    marks = table(spark, sf, "events").filter("event_type IN ('click', 'view')").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", (F.col("event_type") == "click").alias("opens"))
    return E.unbalanced(marks, ["user_id", "day"], "event_id", "opens")


@query(
    """WITH m AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'end' ELSE 'separate' END AS kind FROM events),
    d AS (SELECT *, sum(CASE kind WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM m)
    SELECT user_id, CAST(max(depth) AS BIGINT) AS deepest, bool_or(depth < 0 OR kind = 'separate' AND depth < 1) OR max(depth) FILTER (r = 1) <> 0 AS malformed FROM d GROUP BY 1"""
)
def field_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """W15."""
    kind = F.when(F.col("event_type") == "click", "begin").when(F.col("event_type") == "purchase", "end").otherwise("separate")
    got = E.nesting(table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind")), ["user_id"], "event_id")
    return got.select("user_id", F.col("deepest").cast("long").alias("deepest"), "malformed")


def mapped_segments(spark: SparkSession, sf: str) -> DataFrame:
    """(path, ix, review_start, review_end, source_start, source_end, identity): a space stays a space, other white space becomes one. Words
    and the single spaces between them are one segment, as in the reference; only their sizes are moved."""
    lossy = rf"{T.SPACE}{{2,}}|(?! ){T.SPACE}"
    size = lambda x: F.struct(F.length(x).alias("chars"), F.octet_length(x).alias("bytes"))
    pairs = F.zip_with(F.split("text", lossy, -1), F.regexp_extract_all("text", F.lit(lossy), F.lit(0)), lambda a, b: F.struct(size(a).alias("kept"), size(F.coalesce(b, F.lit(""))).alias("lost")))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(pairs).alias("ix", "p")).select("path", "ix", "p.*")
    w = Window.partitionBy("path").orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({c: F.sum(F.col("kept")[c] + F.col("lost")[c]).over(w) - F.col("lost")[c] for c in ("chars", "bytes")})

    def segment(n: int, kind: str) -> Column:
        first = [F.col(c) - (F.col("kept")[c] if kind == "kept" else F.lit(0)) for c in ("chars", "bytes")]
        ends = [x + F.col(kind)[c] for x, c in zip(first, ("chars", "bytes"), strict=True)]
        names = ("review_start", "review_end", "source_start", "source_end")
        return F.struct((2 * F.col("ix") + n).alias("ix"), *(x.alias(k) for x, k in zip((first[0], ends[0], first[1], ends[1]), names, strict=True)), F.lit(kind == "kept").alias("identity"))

    both = F.array(segment(0, "kept"), segment(1, "lost"))
    return rows.select("path", F.inline(both)).filter("review_end > review_start")


@query(
    rf"""SELECT path, point, CAST(octet_length(encode(left(text, point))) AS BIGINT) AS source, CAST(greatest(0, least(point, 90) - 20) AS BIGINT) AS clamped FROM (
      SELECT doc_id AS path, text, CAST(unnest(range(0, length(text) + 1, 37)) AS BIGINT) AS point FROM documents)"""
)
def offset_map(spark: SparkSession, sf: str) -> DataFrame:
    """The source byte of every 37th place of a review text, through its segments. Runs of white space have one character here, so
    no place lies inside a lossy one."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    points = d.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(37).cast("long"))).alias("point"))
    found = intervals.locate(points, mapped_segments(spark, sf)).join(d, "path")
    place = F.when(F.col("text") == "", F.lit(0)).otherwise(intervals.source_place(F.col("text"), F.col("point").cast("int"), F.col("segment")))
    return found.select("path", "point", place.cast("long").alias("source"), T.clamp(F.col("point"), F.lit(20), F.lit(90)).cast("long").alias("clamped"))


@query(
    """WITH s AS (SELECT doc_id AS path, length(text) // 3 AS a, length(text) // 2 AS b, text FROM documents), p AS (SELECT path, a, b, text, a + position(chr(10) IN substring(text, a + 1, b - a)) - 1 AS pos FROM s WHERE position(chr(10) IN substring(text, a + 1, b - a)) > 0)
    SELECT path, CAST(pos AS BIGINT) AS review_start FROM p"""
)
def lossy_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The first lossy segment that a span enters (here a line break)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("id"), F.floor(F.length("text") / 3).alias("start"), F.floor(F.length("text") / 2).alias("end"))
    parts = mapped_segments(spark, sf)
    return intervals.first_lossy(d, parts).join(parts, ["path", "ix"]).select("path", F.col("review_start").cast("long").alias("review_start"))


@query("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src0', 'src1')")
def unlisted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that neither the manifest nor the reserved folders account for."""
    files = table(spark, sf, "documents").filter(~F.col("source").isin("src0", "src1")).select(F.col("doc_id").alias("path"))
    return files.join(table(spark, sf, "labels").select(F.col("doc_id").alias("path")), "path", "left_anti")


@query(
    """SELECT l_orderkey, l_linenumber, row_number() OVER w <= 4 AND sum(CAST(l_quantity AS BIGINT)) OVER w <= 100 AS ok FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)"""
)
def budget_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows of a group still keep within both of its budgets."""
    rows = table(spark, sf, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    return V.within_budget(rows, ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"], "size", 4, 100).select("l_orderkey", "l_linenumber", "ok")


@query(
    """SELECT page_id, string_agg(target, ' ' ORDER BY lower(target), target) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages) GROUP BY 1"""
)
def folded_order(spark: SparkSession, sf: str) -> DataFrame:
    """L3, L4: names in an order that ignores case first."""
    refs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    order = F.transform(F.array_sort(F.transform(refs, lambda x: F.struct(F.lower(x).alias("l"), x.alias("x")))), lambda s: s["x"])
    return table(spark, sf, "pages").filter(F.size(refs) > 0).select("page_id", F.array_join(order, " ").alias("targets"))


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS size FROM part), e AS (SELECT p_partkey AS source, p_partkey * 2 + k AS target FROM part, unnest([1, 2]) AS u(k) WHERE p_partkey % 7 > 0),
    r AS (SELECT node AS root, node FROM n UNION ALL SELECT root, target FROM r JOIN e ON e.source = r.node JOIN n ON n.node = target)
    SELECT root AS node, CAST(sum(size) AS BIGINT) AS total FROM r JOIN n USING (node) GROUP BY root"""
)
def include_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The size of each file with all that it includes; a cycle is an error."""
    part = table(spark, sf, "part")
    edges = part.filter("p_partkey % 7 > 0").select(F.col("p_partkey").alias("source"), F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 2 + 2)).alias("target"))
    return V.expanded_sizes(edges, part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("size")))


@query("""SELECT event_id, a AS artifact_id, event_type AS path FROM (SELECT event_id, event_type, unnest(['a' || event_id, 'b' || event_id, 'c' || event_id]) AS a FROM events) WHERE left(a, 1) <> 'c' OR event_id % 3 = 0""")
def nested_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifact references wherever they stand in an object, and no objects with other fields."""
    one = lambda k, more="": F.concat(F.lit(f'{{"artifact_id":"{k}'), "event_id", F.lit('","path":"'), "event_type", F.lit(f'"{more}}}'))
    third = F.when(F.col("event_id") % 3 == 0, one("c")).otherwise(one("c", ',"extra":1'))
    json = F.concat(F.lit('{"x":['), one("a"), F.lit(',1,[{"y":'), one("b"), F.lit('}]],"z":{"deep":{"er":'), third, F.lit(',"n":null}}}'))
    return V.nested_objects(table(spark, sf, "events").select("event_id", json.alias("json")), "event_id", "json", ["artifact_id", "path"])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, 'first_has_no_previous' AS rule FROM orders WHERE (o_orderkey % 5 = 1) <> (o_custkey % 3 = 0) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'revision' FROM orders WHERE o_orderkey % 5 < 1""")
def run_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V1."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("revision"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("previous"))
    return validate.run_manifest(runs)


@query(
    """WITH f AS (SELECT CASE WHEN n_nationkey % 9 = 4 THEN 'EGYPT' ELSE n_name END AS path, n_nationkey AS ix FROM nation) SELECT path AS key, 'unique_path' AS rule FROM f GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT path, 'sorted' FROM (SELECT *, lag(path) OVER (ORDER BY ix) AS p FROM f) WHERE path <= p UNION ALL SELECT 'main', 'main_present'"""
)
def source_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest, of a project's few files."""
    return validate.source_manifest(table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 9 == 4, "EGYPT").otherwise(F.col("n_name")).alias("path"), F.col("n_nationkey").alias("ix")), "main")


@query(
    """WITH u AS (SELECT l_orderkey AS path, l_orderkey || '-' || l_linenumber % 3 AS unit_id, l_linenumber AS start, l_suppkey AS ordinal FROM lineitem)
    SELECT unit_id AS key, 'unique_id' AS rule FROM u GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT unit_id, 'increasing' FROM (SELECT *, lag(ordinal) OVER (PARTITION BY path ORDER BY start, unit_id, ordinal) AS p FROM u) WHERE ordinal <= p"""
)
def review_unit_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V3."""
    key = F.concat("l_orderkey", F.lit("-"), F.col("l_linenumber") % 3)
    units = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), key.alias("unit_id"), F.struct("l_linenumber", key.alias("k"), "l_suppkey").alias("start"), F.col("l_suppkey").alias("ordinal"))
    return validate.review_units(units)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS key, 'success_is_bound' AS rule FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 = 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'has_document' FROM documents WHERE doc_id % 3 < 2 AND doc_id % 11 = 1"""
)
def export_report_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V5: a success has all its bindings, and what hasn't failed has its document."""
    i = F.col("doc_id")
    status = F.when(i % 3 == 0, "success").when(i % 3 == 1, "partial").otherwise("failed")
    reports = table(spark, sf, "documents").select(
        i.alias("report_id"), status.alias("status"), F.lit("r").alias("review_ir"), F.when(i % 7 != 1, "m").alias("source_map"), F.when(i % 11 != 1, "d").alias("document")
    )
    return validate.export_reports(reports)


@query(
    f"""WITH {evidence.EVENTS_SQL}, e AS (SELECT event_id, user_id AS part, kind, event_id % 40 AS native_id, CASE WHEN event_id % 6 > 0 THEN 'x' ELSE '' END AS text FROM ev)
    SELECT CAST(event_id AS VARCHAR) AS key, 'deletion_has_text' AS rule FROM e WHERE kind = 'delete' AND text = '' UNION ALL SELECT CAST(native_id AS VARCHAR), 'unique_native_id' FROM e GROUP BY part, kind, native_id HAVING count(*) > 1"""
)
def raw_event_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V6, A8."""
    ev = evidence.revision_events(spark, sf)
    rows = ev.select("event_id", F.col("user_id").alias("part"), "kind", (F.col("event_id") % 40).alias("native_id"), F.when(F.col("event_id") % 6 > 0, "x").otherwise("").alias("text"))
    return validate.raw_events(rows)


@query(
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 30 = 7 THEN doc_id - 1 ELSE doc_id END AS change_id FROM documents)
    SELECT CAST(change_id AS VARCHAR) AS key, 'unique_id' AS rule FROM c GROUP BY change_id HAVING count(*) > 1 UNION ALL SELECT CAST(change_id AS VARCHAR), 'known_events' FROM c WHERE doc_id % 9 = 2 AND doc_id % 10 > 0
    UNION ALL SELECT CAST(change_id AS VARCHAR), 'has_events' FROM c WHERE doc_id % 10 = 0 UNION ALL SELECT CAST(change_id AS VARCHAR), 'safe_is_exact' FROM c WHERE doc_id % 4 = 0 AND doc_id % 3 = 0"""
)
def change_set_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V7."""
    i = F.col("doc_id")
    ids = F.when(i % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.when(i % 9 == 2, -i - 1).otherwise(F.lit(0).cast("long"))))
    changes = table(spark, sf, "documents").select(
        F.when(i % 30 == 7, i - 1).otherwise(i).alias("change_id"), ids.alias("raw_event_ids"), F.when(i % 4 == 0, "safe").otherwise("manual").alias("safety"), F.when(i % 3 == 0, "other").otherwise("exact").alias("resolution")
    )
    return validate.change_set(changes, table(spark, sf, "events").select("event_id"))


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS key, 'pass_is_clean' AS rule FROM lineitem WHERE l_partkey % 2 = 0 AND (l_suppkey % 5 = 0 OR l_linenumber % 3 = 0)")
def verification_violations(spark: SparkSession, sf: str) -> DataFrame:
    """V10."""
    r = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report_id"), F.when(F.col("l_partkey") % 2 == 0, "pass").otherwise("fail").alias("status"), F.lit("a").alias("before"),
        F.when(F.col("l_suppkey") % 5 == 0, "b").otherwise("a").alias("after"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("missing"), F.lit(0).alias("extra"), F.lit(0).alias("duplicate"),
    )
    return validate.verification(r)


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'bound_hash' AS rule FROM documents WHERE doc_id % 12 = 5 OR doc_id % 10 = 4")
def binding_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What a later object says of an earlier one's hash; of some there is none."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("object_id"), F.sha2(T.utf8(F.col("text")), 256).alias("hash"))
    later = d.select("object_id", F.when(F.col("object_id") % 12 == 5, "x").otherwise(F.col("hash")).alias("bound_hash"))
    return validate.bindings(later, d.filter("object_id % 10 <> 4"))


@query(
    f"""WITH {evidence.CHANGES_SQL}, {evidence.ELIGIBLE_SQL} SELECT change_id, 'op_' || left(sha256('["' || change_id || '","' || path || '","' || start || '","' || "end" || '"]'), 32) AS operation_id, change_id % 10 = 3 AS stale FROM pl WHERE outcome = 'operation'"""
)
def plan_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a plan's operations computed again from their contents; a stored one that differs is stale."""
    identity = T.stable_id("op_", F.col("change_id"), F.col("path"), F.col("start"), F.col("end"))
    stored = F.when(F.col("change_id") % 10 == 3, F.lit("op_old")).otherwise(identity)
    rows = evidence.planned(spark, sf).filter("outcome = 'operation'").withColumn("stored", stored)
    return rows.select("change_id", identity.alias("operation_id"), (F.col("stored") != identity).alias("stale"))


@query(
    """SELECT sha256('["' || source || '","' || lang || '"]') AS request, count(*) AS uses, min(doc_id) AS first_id, CASE WHEN bool_or(n_chars > 20000) THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE lang IS NOT NULL GROUP BY 1"""
)
def overlay_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Equal requests once, by their hash, with their uses and a status for all of them."""
    request = F.sha2(T.utf8(F.to_json(F.array("source", "lang"))), 256)
    rows = table(spark, sf, "documents").filter("lang IS NOT NULL").select(request.alias("request"), "doc_id", "n_chars")
    return rows.groupBy("request").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_id"), F.when(F.bool_or(F.col("n_chars") > 20000), "failed").otherwise("ready").alias("status"))


@query(
    f"""WITH {evidence.CHANGES_SQL}, {evidence.ELIGIBLE_SQL}, a AS (SELECT change_id FROM pl WHERE decision = 'accept'), o AS (SELECT change_id FROM pl WHERE outcome = 'operation'), b AS (SELECT change_id FROM pl WHERE outcome = 'blocked')
    SELECT (SELECT count(*) FROM a) AS accepted, (SELECT count(*) FROM o) AS operations, (SELECT count(*) FROM b) AS blocked,
      (SELECT count(*) FROM (SELECT change_id FROM a INTERSECT (SELECT change_id FROM o UNION ALL SELECT change_id FROM b WHERE change_id % 7 = 0) INTERSECT SELECT change_id FROM b WHERE change_id % 11 <> 0)) AS in_both,
      (SELECT count(*) FROM (SELECT change_id FROM a EXCEPT SELECT change_id FROM o EXCEPT SELECT change_id FROM b WHERE change_id % 7 = 0 OR change_id % 11 <> 0)) AS in_neither"""
)
def plan_sets(spark: SparkSession, sf: str) -> DataFrame:
    """What is accepted is planned or blocked, and never both. Of what is blocked some is planned as well, some is lost."""
    p = evidence.planned(spark, sf)
    sets = {"accepted": p.filter("decision = 'accept'"), "operations": p.filter("outcome = 'operation'"), "blocked": p.filter("outcome = 'blocked'")}
    blocked = sets["blocked"].select("change_id")
    faulty = {"operations": sets["operations"].select("change_id").union(blocked.filter("change_id % 7 = 0")), "blocked": blocked.filter("change_id % 11 != 0")}
    parts = reconcile.partition_check(sets["accepted"].select("change_id"), faulty, "change_id")
    wrong = parts.agg(F.count_if(F.col("n") > 1).alias("in_both"), F.count_if(F.col("n") < 1).alias("in_neither"))
    o = F.col("outcome")
    counts = p.agg(F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(o == "operation").alias("operations"), F.count_if(o == "blocked").alias("blocked"))
    return counts.join(F.broadcast(wrong))  # one row on either side

