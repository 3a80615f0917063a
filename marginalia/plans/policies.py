"""Queries over closed vocabularies, scalar rules and canonical forms. What the tables don't hold is set by the number of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import policies as P
from ..functions import text as T
from ..operators import review
from . import evidence
from .registry import query, table


def _pick(number: Column, n: int, values: dict[int, str], other: str | None = None) -> Column:
    """values by number modulo n."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        out = out.when(number % n == k, F.lit(v))
    return out.otherwise(F.lit(other))


def _pick_sql(number: str, n: int, values: dict[int, str], other: str | None = None) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {number} % {n} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(other)} END"


@query(
    """WITH r AS (SELECT DISTINCT user_id AS report, CASE user_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS status FROM events),
    f AS (SELECT user_id AS report, bool_and(event_type <> 'error' AND value > 0.5) AS ok FROM events WHERE user_id % 4 > 0 GROUP BY 1)
    SELECT report, status = 'success' OR status = 'partial' AND coalesce(ok, false) AS reviewable FROM r LEFT JOIN f USING (report)"""
)
def reviewable_exports(spark: SparkSession, sf: str) -> DataFrame:
    """a success, or a partial export whose findings, at least one, are all recoverable warnings."""
    ev = table(spark, sf, "events")
    reports = ev.select(F.col("user_id").alias("report")).distinct().withColumn("status", _pick(F.col("report"), 3, {0: "success", 1: "partial"}, "failed"))
    findings = ev.filter("user_id % 4 > 0").select(F.col("user_id").alias("report"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), (F.col("value") > 0.5).alias("recoverable"))
    return review.reviewable(reports, findings)


@query(
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 > 0 THEN 'code=' || event_type END, CASE WHEN event_id % 5 > 0 THEN 'returncode=' || user_id END,
      CASE WHEN event_id % 2 = 0 THEN 'stage=s-' || user_id || '.1' END) AS details FROM events"""
)
def safe_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """fields that may be shown, without those that hold a path or a space."""
    i = F.col("event_id")
    details = F.create_map(
        F.lit("code"), F.when(i % 3 == 0, F.concat(F.lit("a/"), "event_type")).otherwise(F.col("event_type")), F.lit("path"), F.lit("private"),
        F.lit("returncode"), F.when(i % 5 == 0, F.lit("4 2")).otherwise(F.col("user_id").cast("string")),
        F.lit("stage"), F.when(i % 2 == 0, F.concat(F.lit("s-"), "user_id", F.lit(".1"))).otherwise(F.lit("C:\\x")),
    )
    shown = F.transform(F.array_sort(F.map_entries(P.safe_details(details))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "events").select("event_id", F.array_join(shown, ",").alias("details"))


_ESCAPES = {0: r"\write18{x}", 1: r"\Input |ls", 2: r"\usepackage[a]{minted}", 3: r"\begin{minted}", 4: r"\input{a}", 5: r"\usepackage{mintedx}"}


@query(
    f"""SELECT source, CAST(count_if(regexp_matches(t, '(?i)\\\\(?:immediate\\s*)?write18\\b') OR regexp_matches(t, '(?i)\\\\input\\s*\\|') OR
    regexp_matches(t, '(?i)\\\\(?:usepackage|RequirePackage)(?:\\[[^\\]]*\\])?\\{{minted\\}}') OR regexp_matches(t, '(?i)\\\\begin\\{{minted\\}}')) AS BIGINT) AS unsafe
    FROM (SELECT source, text || ' ' || {_pick_sql('doc_id', 9, _ESCAPES, '')} AS t FROM documents) GROUP BY source"""
)
def shell_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """how many files of a tree ask for shell escapes."""
    d = table(spark, sf, "documents").select("source", F.concat("text", F.lit(" "), _pick(F.col("doc_id"), 9, _ESCAPES, "")).alias("t"))
    return d.groupBy("source").agg(F.count_if(P.shell_escape(F.col("t"))).alias("unsafe"))


_LOGS = {0: "LaTeX Warning: There were Undefined References.", 1: "Citation `a' undefined", 2: "Rerun to get cross-references right.", 3: "Output written"}


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'fail' WHEN doc_id % 6 = 1 THEN 'blocked' WHEN contains(t, 'undefined references') OR contains(t, 'citation `') OR contains(t, 'there were undefined')
    OR contains(t, 'rerun to get cross-references right') THEN 'fail' ELSE 'pass' END AS references FROM (SELECT doc_id, lower(text || {_pick_sql('doc_id', 5, _LOGS, '')}) AS t FROM documents)"""
)
def compile_checks(spark: SparkSession, sf: str) -> DataFrame:
    """F15."""
    i = F.col("doc_id")
    log = F.concat("text", _pick(i, 5, _LOGS, ""))
    return table(spark, sf, "documents").select("doc_id", P.reference_check(log, _pick(i, 6, {0: "fail", 1: "blocked"}, "pass")).alias("references"))


_DIFFS = {0: r"\DIFaddbegin x", 1: r"%DIF PREAMBLE \DIFadd{}", 2: "%DIF < gone", 3: r"\DIFaddx", 4: "DIFadd"}


@query(
    f"""SELECT doc_id, len(list_filter(string_split(text || chr(10) || {_pick_sql('doc_id', 7, _DIFFS, '')}, chr(10)),
    lambda x: regexp_matches(x, '\\\\DIF(?:add|del)(?:FL)?(?:begin|end)?\\b|%DIF\\s+[<>]') AND NOT contains(x, '%DIF PREAMBLE'))) > 0 AS marked FROM documents"""
)
def difference_marks(spark: SparkSession, sf: str) -> DataFrame:
    """F16."""
    t = F.concat("text", F.lit("\n"), _pick(F.col("doc_id"), 7, _DIFFS, ""))
    return table(spark, sf, "documents").select("doc_id", P.has_diff_marks(t).alias("marked"))


_CODES = [*P.CODES, "E_OF_ANOTHER_PROGRAM"]
_CODES_SQL = "(VALUES " + ", ".join(f"({k}, '{c}', {P.CODES.get(c, P.INTERNAL)})" for k, c in enumerate(_CODES)) + ") AS c(k, code, exit_code)"
# Messages of single codes, and of the exit categories of all others.
_OF_CODE = {"E_PATCH_OVERLAP": "two edits overlap", "E_MAP_AMBIGUOUS": "the place is ambiguous"}
_OF_EXIT = {0: "a warning", 4: "the input can't be trusted", 7: "the approval isn't complete", 10: "an internal error"}


@query(f"SELECT event_id, exit_code FROM events JOIN {_CODES_SQL} ON k = event_id % {len(_CODES)}")
def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    """F17."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", P.exit_code(code).alias("exit_code"))


@query(
    f"""SELECT event_id, coalesce(CASE code {' '.join(f"WHEN '{c}' THEN '{m}'" for c, m in _OF_CODE.items())} END,
    CASE exit_code {' '.join(f"WHEN {c} THEN '{m.replace(chr(39), chr(39) * 2)}'" for c, m in _OF_EXIT.items())} END, 'see the log') AS message FROM events JOIN {_CODES_SQL} ON k = event_id % {len(_CODES)}"""
)
def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    """the message of the code, else of its category, else a general one. Both tables are closed vocabularies."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES) + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", code.alias("code"), P.exit_code(code).alias("exit"))
    own = F.broadcast(spark.createDataFrame(list(_OF_CODE.items()), "code string, own string"))
    general = F.broadcast(spark.createDataFrame(list(_OF_EXIT.items()), "exit int, general string"))
    joined = rows.join(own, "code", "left").join(general, "exit", "left")
    return joined.select("event_id", F.coalesce("own", "general", F.lit("see the log")).alias("message"))


@query(
    """WITH e AS (SELECT doc_id AS i, CASE doc_id % 5 WHEN 0 THEN 'snapshotted' WHEN 1 THEN 'exported' ELSE 'ingested' END AS w, CASE WHEN doc_id % 7 > 0 THEN CASE WHEN doc_id % 3 > 0 THEN 'final' ELSE 'draft' END END AS a,
      doc_id % 4 AS pending, CASE WHEN doc_id % 11 > 0 THEN CASE WHEN doc_id % 13 = 0 THEN 'blocked' ELSE 'ready' END END AS p, doc_id % 6 > 0 AS revised, CASE WHEN doc_id % 17 > 0 THEN CASE WHEN doc_id % 19 > 3 THEN 'pass' ELSE 'fail' END END AS v,
      doc_id % 23 > 2 AS ledger, doc_id % 29 > 3 AS audit, doc_id % 31 = 0 AS manifest FROM documents)
    SELECT i AS doc_id, CASE WHEN w = 'snapshotted' THEN 'ready_to_export' WHEN w = 'exported' THEN 'waiting_for_return' WHEN a IS NULL THEN 'approval_required'
      WHEN a = 'draft' AND pending > 0 THEN 'approval_in_progress' WHEN a = 'draft' THEN 'approval_ready_to_finalize' WHEN p IS NULL THEN 'ready_to_plan' WHEN p = 'blocked' THEN 'plan_blocked'
      WHEN NOT revised THEN 'awaiting_apply_confirmation' WHEN v IS NULL THEN 'applied' WHEN v = 'fail' THEN 'partially_completed' WHEN NOT ledger THEN 'verified' WHEN NOT audit THEN 'ready_to_bundle' ELSE 'completed' END AS phase,
      CASE WHEN w = 'snapshotted' THEN 1 WHEN w = 'exported' THEN 2 WHEN a IS NULL OR a = 'draft' OR p IS NULL OR p = 'blocked' THEN 3 ELSE 4 END AS step,
      CASE WHEN w = 'ingested' AND a = 'final' AND p = 'ready' AND revised AND v = 'fail' THEN CASE WHEN ledger OR manifest OR audit THEN 'inspect_partial_results' ELSE 'retry_verification' END ELSE '' END AS partial_action FROM e"""
)
def session_phases(spark: SparkSession, sf: str) -> DataFrame:
    """The phase of a session from the evidence that there is."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", _pick(i, 5, {0: "snapshotted", 1: "exported"}, "ingested").alias("workflow"), F.when(i % 7 > 0, F.when(i % 3 > 0, "final").otherwise("draft")).alias("approval_status"), (i % 4).alias("pending"),
        F.when(i % 11 > 0, F.when(i % 13 == 0, "blocked").otherwise("ready")).alias("plan_status"), (i % 6 > 0).alias("revised"), F.when(i % 17 > 0, F.when(i % 19 > 3, "pass").otherwise("fail")).alias("verification"),
        (i % 23 > 2).alias("ledger"), (i % 29 > 3).alias("audit"), (i % 31 == 0).alias("manifest"),
    ).withColumn("s", P.session_phase())
    partial = F.when(F.col("s.phase") == "partially_completed", F.col("s.next_action")).otherwise("")
    return rows.select("doc_id", "s.phase", "s.step", partial.alias("partial_action"))


@query(
    """SELECT l_orderkey AS run, CASE WHEN bool_or(s = 'blocked') THEN 'blocked' WHEN bool_or(s <> 'pass') THEN 'fail' ELSE 'pass' END AS status FROM (
    SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'fail' ELSE 'pass' END AS s FROM lineitem) WHERE l_orderkey % 2 = 0 OR l_linenumber = 1 GROUP BY 1"""
)
def overall_status(spark: SparkSession, sf: str) -> DataFrame:
    """of runs that need no difference document only the first step counts."""
    rows = table(spark, sf, "lineitem").filter("l_orderkey % 2 = 0 OR l_linenumber = 1")
    return rows.groupBy(F.col("l_orderkey").alias("run")).agg(P.folded_status(_pick(F.col("l_partkey"), 5, {0: "blocked", 1: "fail"}, "pass")).alias("status"))


@query(
    f"""WITH {evidence.CHANGES_SQL} SELECT change_id, CASE WHEN resolution IN ('conflict', 'unmatched', 'unsupported') THEN 'conflict' WHEN kind IN ('comment', 'structural') THEN 'manual'
    WHEN resolution = 'exact' THEN 'pending' ELSE 'manual' END AS initial, cls AS safety FROM de"""
)
def initial_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """F4."""
    rows = review.decided(evidence.changes(spark, sf), evidence.log(spark, sf))
    return rows.select("change_id", review.initial_decision(F.col("kind"), F.col("resolution")).alias("initial"), review.safety_class().alias("safety"))


_PATHS = {0: "a/main.tex", 1: "b/x.CLS", 2: "refs.bib", 3: "img/p.png", 4: "/root.tex", 5: "a/../b.sty", 6: "con.tex", 7: "a//b", 8: "C:/a.tex", 9: "dot./a", 10: "readme", 11: "aux", 12: "a/lpt1.x/b.bst"}
_UNSAFE = (4, 5, 6, 7, 8, 9, 11, 12)
_ROLE = {0: "tex", 1: "class", 2: "bibliography", 3: "image", 4: "tex", 5: "style", 6: "tex", 8: "tex", 12: "style"}


@query(
    f"""SELECT doc_id, {_pick_sql('doc_id', 13, _PATHS)} AS path, doc_id % 13 NOT IN {_UNSAFE} AS safe, {_pick_sql('doc_id', 13, _ROLE, 'other')} AS role,
    left(regexp_replace({_pick_sql('doc_id', 13, _PATHS)} || ':' || source || ' ' || repeat('x', CAST(doc_id % 50 AS INTEGER)), '[^A-Za-z0-9_]', '_', 'g'), 40) AS bookmark FROM documents"""
)
def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    """F8, F9, F19."""
    path = _pick(F.col("doc_id"), 13, _PATHS)
    label = F.concat(path, F.lit(":"), "source", F.lit(" "), F.repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int")))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), T.safe_path(path).alias("safe"), T.role_of(path).alias("role"), T.bookmark_name(label).alias("bookmark"))


@query(
    r"""SELECT doc_id, sha256(array_to_string(s, chr(10))) AS stripped, list_sum(list_transform(l, lambda x: CAST(length(x) AS BIGINT)))::BIGINT AS masked FROM (SELECT doc_id, l,
    list_transform(l, lambda x: regexp_replace(x, '^((?:[^%\\]|\\.|\\$)*)%.*$', '\1')) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def comment_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Comments cut, and masked without moving what follows."""
    cut = F.array_join(F.transform(T.lines(F.col("text")), lambda x: T.strip_comment(x)), "\n")
    masked = F.aggregate(F.transform(T.lines(F.col("text")), lambda x: F.length(T.mask_comment(x)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.utf8(cut), 256).alias("stripped"), masked.alias("masked"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000 WHEN 2 THEN epoch_us(ts) + 19800000000 END AS instant FROM events"""
)
def zoned_times(spark: SparkSession, sf: str) -> DataFrame:
    """An instant only where the offset is stated."""
    suffix = _pick(F.col("event_id"), 5, {0: "Z", 1: "+02:00", 2: "-05:30", 3: ""}, " UTC")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), suffix)
    return table(spark, sf, "events").select("event_id", F.unix_micros(T.zoned_timestamp(stamp)).alias("instant"))


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS BIGINT) * 1000000 WHEN 1 THEN CAST(p_size AS BIGINT) * 72000000 WHEN 2 THEN round_even(p_size * 7200000000.0 / 7227, 0) WHEN 3 THEN round_even(p_size * 7200000000.0 / 254, 0)
    WHEN 4 THEN round_even(p_size * 720000000.0 / 254, 0) END AS BIGINT) AS micro_bp FROM part"""
)
def length_units(spark: SparkSession, sf: str) -> DataFrame:
    """T24."""
    length = F.concat(F.col("p_size"), _pick(F.col("p_partkey"), 6, {0: "bp", 1: " in", 2: "pt", 3: "cm", 4: " mm"}, "em"))
    return table(spark, sf, "part").select("p_partkey", T.micro_bp(length).alias("micro_bp"))


@query("SELECT page_id, replace(replace(url, 'http://', '<root>'), 'example', '<root>') AS url FROM pages")
def redacted_logs(spark: SparkSession, sf: str) -> DataFrame:
    """T30."""
    return table(spark, sf, "pages").select("page_id", T.redacted(F.col("url"), ["example", "http://"]).alias("url"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS BIGINT) END AS minor, CASE WHEN p_partkey % 4 < 3 THEN (p_size, p_partkey % 10) > (25, 5) END AS newer FROM part"""
)
def version_order(spark: SparkSession, sf: str) -> DataFrame:
    """Versions in order of their numbers, not of their text; 01 is no number."""
    v = T.version_parts(F.concat(F.lit("1."), "p_size", F.lit("."), (F.col("p_partkey") % 10).cast("string"), _pick(F.col("p_partkey"), 4, {0: "", 1: "-rc.1", 2: "+b"}, ".9")))
    floor = F.struct(F.lit(1).cast("long").alias("major"), F.lit(25).cast("long").alias("minor"), F.lit(5).cast("long").alias("patch"))
    return table(spark, sf, "part").select("p_partkey", v["minor"].alias("minor"), (v > floor).alias("newer"))


@query(
    """SELECT event_id, 'run_' || left(t, 8) || '-' || substring(t, 9, 4) || '-7' || format('{:03x}', event_id % 4096) || '-' || format('{:04x}', 32768 + ((event_id * 7919 * 1000003) >> 48) % 16384) || '-' ||
    format('{:012x}', (event_id * 7919 * 1000003) % 281474976710656) AS run_id FROM (SELECT event_id, format('{:012x}', epoch_us(ts) // 1000) AS t FROM events)"""
)
def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    """T4: time-ordered ids; what is random in one is given by the row's number here."""
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", C.run_id(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)"), i % 4096, i * 7919 * 1000003).alias("run_id"))


def _value_json(value: Column) -> Column:
    """What a double is in canonical JSON, for those of the table (two decimals)."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


@query(
    r"""SELECT event_id, '{"a":[' || regexp_replace(CAST(value AS VARCHAR), '\.0$', '') || ',null,true,1e+21,1e-7],"k":' || json_extract_string(props, '$.k') || ',"é":"' || event_type || '\n"}' AS canonical FROM events"""
)
def canonical_props(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in order, no spaces, numbers in their shortest form."""
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{ "é" : "'), "event_type", F.lit('\\u000a", "k":'), k, F.lit('.0, "a" : ['), F.col("value").cast("string"), F.lit("0, null, true, 1000000000000000000000.0, 0.0000001]}"))
    return table(spark, sf, "events").select("event_id", C.canonical_json(raw).alias("canonical"))


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, envelope): sealed objects with their keys in another order; of ten one has another payload, one another run, one a key twice."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    sha = lambda c: T.tagged_sha256(T.utf8(c))
    rows = table(spark, sf, "events").select("event_id", k.alias("k"), sha(F.concat(F.lit('{"k":'), k, F.lit(',"n":'), i, F.lit("}"))).alias("p"))
    document = sha(F.concat(F.lit('{"integrity":{"payload_sha256":"'), "p", F.lit('"},"payload":{"k":'), "k", F.lit(',"n":'), "event_id", F.lit('},"run":"r"}')))
    extra = F.when(F.col("event_id") % 10 == 9, F.lit(', "n": 1')).otherwise("")
    envelope = F.concat(
        F.lit('{"run": "'), F.when(F.col("event_id") % 10 == 7, "other").otherwise("r"), F.lit('", "payload": {"n": '), F.when(F.col("event_id") % 10 == 3, F.lit("-1")).otherwise(F.col("event_id").cast("string")),
        extra, F.lit(', "k": '), "k", F.lit('}, "integrity": {"document_sha256": "'), document, F.lit('", "payload_sha256": "'), "p", F.lit('"}}'),
    )
    return rows.select("event_id", envelope.alias("envelope"))


@query("SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'payload_sha256' WHEN 7 THEN 'document_sha256' ELSE 'unreadable' END AS fault FROM events WHERE event_id % 10 IN (3, 7, 9)")
def envelope_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed objects whose hashes aren't those of their contents, and those that can't be read strictly."""
    return envelopes(spark, sf).select("event_id", C.envelope_fault(F.col("envelope")).alias("fault")).filter("fault IS NOT NULL")


@query("""SELECT doc_id, 'sha256:' || sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n":' || n_chars || ',"self":null}') AS commitment FROM documents""")
def report_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """A hash over a report in which the field that will hold it is null."""
    raw = F.to_json(F.struct(F.lit("sha256:old").alias("self"), F.col("n_chars").alias("n"), F.col("lang").alias("lang")), {"ignoreNullFields": "false"})
    return table(spark, sf, "documents").select("doc_id", C.commitment("self")(raw).alias("commitment"))


@query(
    """WITH g AS (SELECT p_partkey, p_size * 10 + 1 AS w, p_partkey % 500 + 1 AS h, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 4000 * 22500 % 360000 ELSE p_partkey * 7919 % 360000 END AS a FROM part),
    t AS (SELECT *, round(cos(-radians(a / 1000.0)), 15) AS c, round(sin(-radians(a / 1000.0)), 15) AS s FROM g), d AS (SELECT *, c * (-w / 2.0) + s * (-h / 2.0) + w / 2.0 AS dx, -s * (-w / 2.0) + c * (-h / 2.0) + h / 2.0 AS dy FROM t)
    SELECT p_partkey, CAST(CASE WHEN a IN (0, 180000) THEN w WHEN a IN (90000, 270000) THEN h ELSE ceil(greatest(dx, c * w + dx, c * w + s * h + dx, s * h + dx)) - floor(least(dx, c * w + dx, c * w + s * h + dx, s * h + dx)) END AS BIGINT) AS width,
      CAST(CASE WHEN a IN (0, 180000) THEN h WHEN a IN (90000, 270000) THEN w ELSE ceil(greatest(dy, -s * w + dy, -s * w + c * h + dy, c * h + dy)) - floor(least(dy, -s * w + dy, -s * w + c * h + dy, c * h + dy)) END AS BIGINT) AS height,
      (SELECT CAST(max(r) AS INTEGER) FROM (SELECT unnest(range(72, 301)) AS r) WHERE greatest(ceil(w * 5 * r / 72.0), ceil(h * 3 * r / 72.0)) <= 4000 AND ceil(w * 5 * r / 72.0) * ceil(h * 3 * r / 72.0) <= 6000000) AS dpi FROM d"""
)
def image_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The canvas of a rotated image, and the greatest resolution within the limits."""
    k = F.col("p_partkey")
    angle = F.when(k % 4 == 0, k % 4000 * 22500 % 360000).otherwise(k * 7919 % 360000)
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10 + 1).alias("w"), (k % 500 + 1).alias("h"), angle.alias("a"))
    b = P.rotated_bounds(F.col("w"), F.col("h"), F.col("a"))
    return rows.select("p_partkey", b["width"].alias("width"), b["height"].alias("height"), P.best_dpi(F.col("w") * 5, F.col("h") * 3, 300, 72, 4000, 6_000_000).alias("dpi"))


@query(
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS x, sha256(text) AS f, octet_length(encode(text)) // 3 AS a, octet_length(encode(text)) // 2 AS b FROM documents)
    SELECT doc_id, 'sha256:' || sha256('{"file_sha256":"sha256:' || f || '","path":"' || doc_id || '","prefix":"sha256:' || sha256(from_hex(substring(x, 2 * greatest(a - 32, 0) + 1, 2 * least(a, 32)))) || '","suffix":"sha256:'
      || sha256(from_hex(substring(x, 2 * b + 1, 64))) || '"}') AS fingerprint FROM d"""
)
def context_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """What stands 32 bytes around a span, and which file it is."""
    raw = T.utf8(F.col("text"))
    size = F.octet_length("text")
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"), F.floor(size / 3).cast("int").alias("a"), F.floor(size / 2).cast("int").alias("b"))
    return d.select("doc_id", T.context_fingerprint(F.col("doc_id").cast("string"), F.col("raw"), F.col("a"), F.col("b")).alias("fingerprint"))
