"""Queries over texts: anchoring, normalisation, offsets, hashes, scans. Texts stand in for source files, lines for units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import anchors, events, intervals, ordinals, reconcile
from .registry import query, table

# The white space of functions.text, in the other engine's notation.
SPACE = r"[\x{1c}-\x{1f}\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NORMAL = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"

STATUS_SQL = f"""
WITH p AS (SELECT item_id, {NORMAL} AS t FROM benchmark),
d AS (SELECT doc_id, {NORMAL} AS t FROM documents),
n AS (SELECT item_id, sum((length(d.t) - length(replace(d.t, p.t, ''))) // length(p.t)) AS n
      FROM p JOIN d ON p.t <> '' AND contains(d.t, p.t) GROUP BY item_id),
k AS (SELECT t, count(*) AS twins FROM p GROUP BY t),
s AS (SELECT item_id, CAST(coalesce(n, 0) AS BIGINT) AS n, twins FROM p JOIN k USING (t) LEFT JOIN n USING (item_id))
SELECT item_id, n, CASE WHEN n > 1 OR n = 1 AND twins > 1 THEN 'conflict' WHEN n = 1 THEN 'exact' ELSE 'unmapped' END AS status,
       CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND twins > 1 THEN 'duplicate_source' WHEN n = 0 THEN 'not_found' END AS reason
FROM s
"""


@query(STATUS_SQL)
def anchor_status(spark: SparkSession, sf: str) -> DataFrame:
    """Which passages stand exactly once in the corpus."""
    return anchors.anchor_status(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query(
    f"""SELECT count(*) AS total, CAST(count_if(status = 'exact') AS BIGINT) AS exact, CAST(count_if(status = 'degraded') AS BIGINT) AS degraded,
    CAST(count_if(status = 'unmapped') AS BIGINT) AS unmapped, CAST(count_if(status = 'conflict') AS BIGINT) AS conflict FROM ({STATUS_SQL})"""
)
def anchor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A4 over J6."""
    return anchors.coverage(anchor_status(spark, sf))


@query(f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    """T5."""
    return table(spark, sf, "documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


@query(
    """SELECT doc_id, 'sha256:' || sha256(text) AS digest,
    'unit_' || left(sha256('["' || doc_id || '","' || coalesce(lang, '') || '"]'), 32) AS stable_id,
    sha256('user' || chr(0) || CAST(doc_id AS VARCHAR)) AS token FROM documents"""
)
def hashes_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    """T1, T3, T26."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        T.tagged_sha256(T.utf8(F.col("text"))).alias("digest"),
        T.stable_id("unit_", F.col("doc_id"), F.coalesce("lang", F.lit(""))).alias("stable_id"),
        T.anonymous_token("user", F.col("doc_id").cast("string")).alias("token"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1 THEN 'mixed' WHEN crlf > 0 THEN 'crlf'
    WHEN lf > 0 THEN 'lf' WHEN cr > 0 THEN 'cr' ELSE 'none' END AS newline, plain, dynamic FROM (
    SELECT doc_id, c AS crlf, n - c AS lf, r - c AS cr, plain, dynamic FROM (SELECT doc_id,
      (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 AS c, length(text) - length(replace(text, chr(10), '')) AS n,
      length(text) - length(replace(text, chr(13), '')) AS r,
      length(text) > 0 AND regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '[\\{}$&#_^~%]') AND NOT regexp_matches(text, '--|``|''''') AS plain,
      regexp_matches(text, '[\\#$~{}]') AS dynamic FROM documents))"""
)
def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """F7, F10, F11."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.newline_style(t).alias("newline"), T.plain_candidate(t).alias("plain"), T.dynamic_reference(t).alias("dynamic")
    )


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty lines of the texts as units: (path, unit_id, start, end, text), in characters."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ix", "text"))
    w = Window.partitionBy("doc_id").orderBy("ix")
    end = F.sum(F.length("text") + 1).over(w) - 1
    rows = d.withColumn("end", end).withColumn("start", F.col("end") - F.length("text")).filter("text != ''")
    return rows.select(F.col("doc_id").alias("path"), F.concat_ws("-", "doc_id", "ix").alias("unit_id"), "start", "end", "text")


UNITS_SQL = """units AS (
  SELECT doc_id AS path, doc_id || '-' || ix AS unit_id, e - length(text) AS start, e AS "end", text FROM (
    SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS e FROM (
      SELECT doc_id, unnest(range(len(l))) AS ix, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
  WHERE text <> '')"""


@query(
    f"""WITH {UNITS_SQL} SELECT path, unit_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", row_number() OVER w - 1 AS ordinal,
    concat_ws(',', lag(unit_id) OVER w, lead(unit_id) OVER w) AS neighbours FROM units WINDOW w AS (ORDER BY path, start, "end")"""
)
def unit_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """W1, W2 over the whole corpus: a number in the order of path and place, and the units before and after."""
    rows = ordinals.with_neighbours(ordinals.numbered(units(spark, sf), ["path", "start", "end"]), "unit_id")
    return rows.select("path", "unit_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ordinal", F.array_join("neighbours", ",").alias("neighbours"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of white space and of everything else, with character and byte cursors."""
    d = table(spark, sf, "documents")
    runs = F.regexp_extract_all("text", F.lit(f"({T.SPACE}+|{T.SPACE.replace('[', '[^', 1)}+)"), F.lit(0))
    rows = d.select(F.col("doc_id").alias("path"), F.octet_length("text").alias("total"), F.posexplode(runs).alias("ix", "run"))
    w = Window.partitionBy("path").orderBy("ix")
    rows = rows.withColumns({"end": F.sum(F.octet_length("run")).over(w), "chars": F.sum(F.length("run")).over(w)})
    return rows.select(
        "path", "ix", (F.col("end") - F.octet_length("run")).alias("start"), "end", (F.col("chars") - F.length("run")).alias("first_char"), "total",
        F.when(F.col("run").rlike(f"^{T.SPACE}"), "space").otherwise("text").alias("kind"), F.length("run").alias("chars_in"),
        F.when(F.col("run") == " ", " ").alias("copied"),
    )


@query(
    rf"""SELECT path, count(*) AS n, CAST(count_if(kind = 'space') AS BIGINT) AS spaces, CAST(sum(end_ - start) AS BIGINT) AS bytes, CAST(max(end_ - start) AS BIGINT) AS longest FROM (
      SELECT path, octet_length(encode(run)) AS end_, 0 AS start, CASE WHEN regexp_matches(run, '^{SPACE}') THEN 'space' ELSE 'text' END AS kind FROM (
        SELECT doc_id AS path, unnest(regexp_extract_all(text, '{SPACE}+|{SPACE.replace('[', '[^', 1)}+')) AS run FROM documents)) GROUP BY path"""
)
def provenance_segments(spark: SparkSession, sf: str) -> DataFrame:
    """What a text's segments add up to. Runs of space and of text take turns, so one count and the two ends give the number of both; only
    the longest needs pieces: the text between spaces, and spaces of more than a byte."""
    text, first = F.col("text"), lambda c: c.cast("long")
    spaces = F.regexp_count("text", F.lit(f"{T.SPACE}+")).cast("long")
    n = 2 * spaces + 1 - first(text.rlike(rf"\A{T.SPACE}")) - first(text.rlike(rf"{T.SPACE}\z"))
    longest = lambda pieces: F.array_max(F.transform(pieces, lambda x: F.octet_length(x)))
    wide = F.regexp_extract_all("text", F.lit(rf"{T.SPACE}{{2,}}|(?![\x00-\x7F]){T.SPACE}"), F.lit(0))
    most = F.greatest(longest(F.split("text", f"{T.SPACE}+", -1)), longest(wide), F.when(spaces > 0, 1))
    d = table(spark, sf, "documents").filter("text <> ''")
    return d.select(F.col("doc_id").alias("path"), n.alias("n"), spaces.alias("spaces"), F.octet_length("text").cast("long").alias("bytes"), most.cast("long").alias("longest"))


_GAPS_SQL = rf"""SELECT path, ix, start, CAST("end" AS INTEGER) AS "end", total FROM (
  SELECT *, CAST(coalesce(sum(octet_length(encode(run))) OVER (PARTITION BY path ORDER BY ix), 0) AS BIGINT) AS "end", "end" - octet_length(encode(run)) AS start FROM (
    SELECT doc_id AS path, CAST(unnest(range(len(r))) AS INTEGER) AS ix, unnest(r) AS run, octet_length(encode(text)) AS total FROM (
      SELECT doc_id, text, regexp_extract_all(text, '{SPACE}+|{SPACE.replace('[', '[^', 1)}+') AS r FROM documents)))
  WHERE NOT (path % 5 = 0 AND ix = 3) AND NOT (path % 7 = 0 AND "end" = total)"""


@query(
    f"""WITH s AS ({_GAPS_SQL}), o AS (SELECT *, coalesce(lag("end") OVER w, 0) AS expected, lead(ix) OVER w IS NULL AND "end" <> total AS short FROM s WINDOW w AS (PARTITION BY path ORDER BY ix))
    SELECT path, ix, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(expected AS BIGINT) AS expected FROM o WHERE start <> expected OR short"""
)
def segment_contiguity_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The segments must cover every text without a gap. Of every fifth text the fourth segment is missing, of every seventh the last."""
    rows = segments(spark, sf).filter(~((F.col("path") % 5 == 0) & (F.col("ix") == 3)) & ~((F.col("path") % 7 == 0) & (F.col("end") == F.col("total"))))
    found = intervals.contiguity_violations(rows)
    return found.select("path", "ix", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "expected")))


@query("SELECT doc_id, CAST(length_grapheme(text) AS BIGINT) AS graphemes, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def grapheme_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Extended grapheme clusters, code points and bytes."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.regexp_count(t, F.lit(r"\X")).cast("long").alias("graphemes"), F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes")
    )


@query(
    r"""SELECT doc_id, CAST(octet_length(encode(p)) AS BIGINT) AS byte_at,
    1 + len(string_split_regex(p, '\r\n|\n|\r')) - 1 AS line, CAST(length(list_last(string_split_regex(p, '\r\n|\n|\r'))) + 1 AS BIGINT) AS col,
    regexp_matches(right(p, 1), '[\p{L}\p{N}_]') AND regexp_matches(substring(text, length(p) + 1, 1), '[\p{L}\p{N}_]') AS in_word
    FROM (SELECT doc_id, text, left(text, length(text) // 2) AS p FROM documents)"""
)
def offset_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """T7, T8, T10 for the middle of every text."""
    d = table(spark, sf, "documents").withColumn("at", F.floor(F.length("text") / 2).cast("int"))
    d = d.withColumn("p", F.substring("text", F.lit(1), F.col("at")))
    return d.select(
        "doc_id", T.byte_offset(F.col("text"), F.col("at")).alias("byte_at"), T.line_of(F.col("p")).alias("line"),
        T.column_of(F.col("p")).alias("col"), T.splits_word(F.col("text"), F.col("at")).alias("in_word"),
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """One scan of the texts for all rules."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.findings(F.col("text"), T.PRIVACY_RULES)).alias("m"))
    return rows.select("doc_id", "m.rule", "m.start_byte", T.tagged_sha256(T.utf8(F.col("m.value"))).alias("digest"))


FINDINGS_SQL = " UNION ALL ".join(
    # a match's offset: the bytes of the first ix + 1 pieces between matches and of the first ix matches
    f"""SELECT doc_id, '{rule}' AS rule, CAST(octet_length(encode(array_to_string(g[1:ix], '') || array_to_string(m[1:ix - 1], ''))) AS BIGINT) AS start_byte,
    'sha256:' || sha256(m[ix]) AS digest FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS ix FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents))"""
    for rule, pattern in T.PRIVACY_RULES.items()
)


@query(FINDINGS_SQL)
def privacy_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Places and digests, never the values themselves."""
    return findings(spark, sf)


@query(
    f"""SELECT * FROM (SELECT count(*) AS files_scanned, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_scanned FROM documents),
    (SELECT count(*) AS findings, count(DISTINCT doc_id) AS files_with_findings FROM ({FINDINGS_SQL}))"""
)
def privacy_report(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    scanned = table(spark, sf, "documents").agg(F.count("*").alias("files_scanned"), F.sum(F.octet_length("text")).cast("long").alias("bytes_scanned"))
    found = findings(spark, sf).agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("files_with_findings"))
    return scanned.join(F.broadcast(found))  # one row on either side


@query(
    """SELECT source, doc_id // 1000 AS tree, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, 'sha256:' || sha256('[' || string_agg(
    '{"path":' || doc_id || ',"sha256":"' || sha256(text) || '"}', ',' ORDER BY doc_id) || ']') AS tree_hash FROM documents GROUP BY 1, 2"""
)
def tree_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One hash per project tree over its sorted entries. A thousand ids of a source stand for a project, whose files are few."""
    d = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("tree"), "doc_id", F.octet_length("text").alias("n"), F.sha2(T.utf8(F.col("text")), 256).alias("sha"))
    row = F.struct(F.col("doc_id").alias("path"), F.col("sha").alias("sha256"))
    return d.groupBy("source", "tree").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("bytes"), T.canonical_rows(row, F.col("doc_id")).alias("tree_hash"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY 1")
def manifest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One entry for each different content; the first and the last that carry it."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(T.utf8(F.col("text")), 256).alias("sha"))
    return d.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A8, J1."""
    return reconcile.repeated(table(spark, sf, "documents").select(F.sha2(T.utf8(F.col("text")), 256).alias("sha")), ["sha"])


@query(
    r"""SELECT feature, CAST(sum(n) AS BIGINT) AS n, min(page_id) FILTER (n > 0) AS first_page FROM (
      SELECT page_id, unnest(['article', 'h1', 'li', 'p', 'script']) AS feature,
             unnest([len(regexp_extract_all(html, '<' || t || '[ >]')) for t in ['article', 'h1', 'li', 'p', 'script']]) AS n FROM pages)
    GROUP BY feature"""
)
def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each structure stands in all pages, and the first page that has it."""
    tags = ("article", "h1", "li", "p", "script")
    counts = F.array(*(F.struct(F.lit(t).alias("feature"), F.regexp_count("html", F.lit(f"<{t}[ >]")).alias("n")) for t in tags))
    rows = table(spark, sf, "pages").select("page_id", F.inline(counts))
    return rows.groupBy("feature").agg(F.sum("n").cast("long").alias("n"), F.min(F.when(F.col("n") > 0, F.col("page_id"))).alias("first_page"))


@query(
    r"""SELECT feature, source_n, output_n, CASE WHEN source_n = output_n THEN 'preserved' WHEN output_n > source_n THEN 'failed'
    WHEN output_n = 0 THEN 'unsupported' ELSE 'degraded' END AS status FROM (
      SELECT t AS feature, CAST(sum(len(regexp_extract_all(html, '<' || t || '[ >]'))) AS BIGINT) AS source_n,
             CAST(sum(len(regexp_extract_all(html, '</' || t || '>'))) AS BIGINT) AS output_n
      FROM pages, unnest(['article', 'h1', 'li', 'p', 'br']) AS u(t) GROUP BY t)"""
)
def feature_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Opening tags stand in for source features, closing tags for what the output has."""
    pages, tags = table(spark, sf, "pages"), ("article", "h1", "li", "p", "br")

    def counted(pattern: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(t).alias("feature"), F.regexp_count("html", F.lit(pattern % t)).alias("n")) for t in tags))
        return pages.select(F.inline(each)).groupBy("feature").agg(F.sum("n").cast("long").alias("n"))

    return reconcile.feature_status(counted("<%s[ >]"), counted("</%s>"))


@query(
    r"""SELECT page_id, CAST(ix - 1 AS INTEGER) AS ix, refs[ix] AS target FROM (SELECT page_id, refs, unnest(range(1, len(refs) + 1)) AS ix
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS refs FROM pages))"""
)
def reference_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """T14."""
    refs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(refs).alias("ix", "target"))


@query(
    r"""WITH r AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages),
    f AS (SELECT DISTINCT '/' || lower(regexp_extract(html, 'href="/([^"]*)"', 1)) || ext AS path, lower(regexp_extract(html, 'href="/([^"]*)"', 1)) || ext AS k
          FROM pages, unnest(['', '.html']) AS e(ext) WHERE page_id % 2 = 0 OR ext = ''),
    j AS (SELECT source, name, count(DISTINCT path) AS n, min(path) AS path FROM r LEFT JOIN f ON k IN (lower(name), lower(name) || '.html') GROUP BY ALL)
    SELECT source, name, CASE n WHEN 1 THEN 'found' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE n WHEN 1 THEN path END AS target FROM j"""
)
def reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each link against the files that exist. A file is named by the first link of a page, on even pages in two forms."""
    pages = table(spark, sf, "pages")
    refs = pages.select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name")).distinct()
    name = F.lower(F.regexp_extract("html", 'href="/([^"]*)"', 1))
    forms = F.when(F.col("page_id") % 2 == 0, F.array(F.lit(""), F.lit(".html"))).otherwise(F.array(F.lit("")))
    files = pages.select(name.alias("name"), F.explode(forms).alias("form")).select(F.concat("name", "form").alias("path")).distinct()
    got = reconcile.resolve_references(refs, files, ["", ".html"])
    return got.withColumn("target", F.concat(F.lit("/"), "target"))


@query(
    """WITH d AS (SELECT conv_id, turn, text, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected FROM conversations),
    l AS (SELECT *, CASE WHEN turn % 5 = 3 THEN sha256('tampered') ELSE before END AS previous FROM d)
    SELECT conv_id, turn, CAST(expected AS BIGINT) AS expected FROM l WHERE turn <> expected OR before IS DISTINCT FROM previous"""
)
def hash_chain_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as revisions of a log in which every fifth was tampered with."""
    own = F.sha2(T.utf8(F.col("text")), 256)
    w = Window.partitionBy("conv_id").orderBy("turn")
    log = table(spark, sf, "conversations").select("conv_id", "turn", own.alias("own"))
    log = log.withColumn("previous", F.when(F.col("turn") % 5 == 3, F.sha2(F.lit(b"tampered"), 256)).otherwise(F.lag("own").over(w)))
    return events.chain_violations(log, "conv_id", "turn", "own", "previous").select("conv_id", "turn", F.col("expected").cast("long").alias("expected"))


@query(
    r"""SELECT conv_id, string_agg('<tr><td>' || turn || '</td><td>' || e || '</td></tr>', '' ORDER BY turn) AS html FROM (
    SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(text, '---', '—'), '--', '–'), '&', '&amp;'), '<', '&lt;'),
      '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM conversations) GROUP BY conv_id"""
)
def ledger_html(spark: SparkSession, sf: str) -> DataFrame:
    """Escaped table rows in order."""
    cell = T.html_escape(T.dashes(F.col("text")))
    row = F.concat(F.lit("<tr><td>"), F.col("turn"), F.lit("</td><td>"), cell, F.lit("</td></tr>"))
    rows = F.sort_array(F.collect_list(F.struct("turn", row.alias("r"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["r"]), "").alias("html"))
