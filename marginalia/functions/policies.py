"""Closed vocabularies and the decisions that are folded from them: exit codes, phases, statuses, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines

# Exit categories and the stable codes of each.
EXIT_CODES = {
    0: "W_EXPORT_DEGRADED W_REVISION_AUTHOR_MISSING W_REVISION_TIMESTAMP_MISSING W_REVISION_STRUCTURED_TEXT",
    2: "E_SCHEMA_INVALID E_SCHEMA_MAJOR_UNSUPPORTED E_SCHEMA_UNKNOWN_SECURITY_FIELD",
    3: "E_TOOL_MISSING E_TOOL_VERSION_UNSUPPORTED E_BACKEND_CAPABILITY_MISSING",
    4: "E_PATH_ABSOLUTE E_PATH_TRAVERSAL E_PATH_LINK_ESCAPE E_HASH_INTEGRITY_MISMATCH E_HASH_SOURCE_MISMATCH E_HASH_CHANGESET_MISMATCH "
    "E_HASH_APPROVAL_MISMATCH E_HASH_PATCHPLAN_MISMATCH E_HASH_RETURNED_ORIGINAL_MISMATCH E_DOCX_INVALID_PACKAGE E_DOCX_UNSAFE_RELATIONSHIP",
    5: "E_BACKEND_FAILED E_EXPORT_SILENT_LOSS E_REVIEW_TRACKING_DISABLED",
    6: "E_REVISION_DELETE_TEXT_MISSING E_REVISION_BASELINE_DRIFT E_REVISION_VIEW_UNSUPPORTED E_REVISION_RECONCILIATION E_MAP_UNMATCHED E_MAP_AMBIGUOUS "
    "E_MAP_CONFIDENCE_LOW",
    7: "E_APPROVAL_NOT_FINAL E_APPROVAL_CHANGE_UNKNOWN E_APPROVAL_FINAL_TEXT_REQUIRED E_PATCH_UNSAFE_KIND E_PATCH_ACCEPTED_BUT_BLOCKED",
    8: "E_PATCH_SOURCE_DRIFT E_PATCH_OVERLAP E_PATCH_UNAPPROVED_CHANGE E_APPLY_PARTIAL_WRITE",
    9: "E_VERIFY_COMPILE_FAILED E_VERIFY_DIFF_MISMATCH E_VERIFY_ORIGINAL_MUTATED E_BUNDLE_HASH_MISMATCH E_BUNDLE_PRIVATE_RELEASE",
    10: "E_INTERNAL_INVARIANT",
}
INTERNAL = 10
CODES = {code: exit_ for exit_, codes in EXIT_CODES.items() for code in codes.split()}
# What a source may not ask for, marks of a difference document, and marks of unresolved references in a log.
SHELL_ESCAPES = (r"(?i)\\(?:immediate\s*)?write18\b", r"(?i)\\input\s*\|", r"(?i)\\(?:usepackage|RequirePackage)(?:\[[^\]]*\])?\{minted\}", r"(?i)\\begin\{minted\}")
DIFF_USE, DIFF_PREAMBLE = r"(?:\\DIF(?:add|del)(?:FL)?(?:begin|end)?\b|%DIF\s+[<>])", "%DIF PREAMBLE"
UNRESOLVED = ("undefined references", "citation `", "there were undefined", "rerun to get cross-references right")
# Fields of a diagnostic that may be shown.
SHOWN = (
    "provider stage name hex code exception_type winerror export_status backend_status backend_error_code failure_kind timed_out returncode duration_ms "
    "error_count warning_count output_truncated finding_count"
).split()


def exit_code(code: Column) -> Column:
    """The exit category of a stable code; an unknown one is an internal error."""
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(F.element_at(table, code), F.lit(INTERNAL))


def shell_escape(text: Column) -> Column:
    found = F.lit(False)
    for pattern in SHELL_ESCAPES:
        found = found | text.rlike(pattern)
    return found


def has_diff_marks(text: Column) -> Column:
    """A line uses a mark of the difference tool and isn't part of its preamble."""
    return F.exists(lines(text), lambda x: x.rlike(DIFF_USE) & ~x.contains(DIFF_PREAMBLE))


def reference_check(log: Column, compiled: Column) -> Column:
    """pass, fail, or the status of a compilation that didn't pass."""
    low = F.lower(log)
    unresolved = F.lit(False)
    for mark in UNRESOLVED:
        unresolved = unresolved | low.contains(mark)
    return F.when(compiled != "pass", compiled).when(unresolved, "fail").otherwise("pass")


def safe_details(details: Column) -> Column:
    """Of a map of strings, the fields that may be shown, with values that hold no path, space or control character."""
    return F.map_filter(details, lambda k, v: k.isin(*SHOWN) & v.rlike(r"^[A-Za-z0-9._-]{1,96}$"))


def folded_status(status: Column) -> Column:
    """Aggregate: blocked before fail before pass."""
    return F.when(F.bool_or(status == "blocked"), "blocked").when(F.bool_or(status != "pass"), "fail").otherwise("pass")


def session_phase() -> Column:
    """struct<phase, step, next_action> from the evidence columns workflow, approval_status, pending, plan_status, revised, verification,
    ledger, manifest and audit; null stands for evidence that isn't there."""
    at = lambda phase, step, action: F.struct(F.lit(phase).alias("phase"), F.lit(step).alias("step"), F.lit(action).alias("next_action"))
    c = F.col
    retry = ~(c("ledger") | c("manifest") | c("audit"))
    # The phases of a session in order, with what comes next.
    return (
        F.when(c("workflow") == "snapshotted", at("ready_to_export", 1, "generate_review_word"))
        .when(c("workflow") == "exported", at("waiting_for_return", 2, "import_returned_word"))
        .when(c("approval_status").isNull(), at("approval_required", 3, "start_approval"))
        .when((c("approval_status") != "final") & (c("pending") > 0), at("approval_in_progress", 3, "decide_remaining_changes"))
        .when(c("approval_status") != "final", at("approval_ready_to_finalize", 3, "finalize_approval"))
        .when(c("plan_status").isNull(), at("ready_to_plan", 3, "prepare_patch_preview"))
        .when(c("plan_status") == "blocked", at("plan_blocked", 3, "revise_approval"))
        .when(~c("revised"), at("awaiting_apply_confirmation", 4, "confirm_patch_preview"))
        .when(c("verification").isNull(), at("applied", 4, "verify_results"))
        .when((c("verification") != "pass") & retry, at("partially_completed", 4, "retry_verification"))
        .when(c("verification") != "pass", at("partially_completed", 4, "inspect_partial_results"))
        .when(~c("ledger"), at("verified", 4, "build_ledger"))
        .when(~c("audit"), at("ready_to_bundle", 4, "create_audit_bundle"))
        .otherwise(at("completed", 4, "open_results"))
    )


def rotated_bounds(width: Column, height: Column, millidegrees: Column) -> Column:
    """struct<width, height> of a canvas that holds a rotated image; right angles are exact."""
    radians = -F.radians(millidegrees / 1000)
    c, s = F.round(F.cos(radians), 15), F.round(F.sin(radians), 15)
    x0, y0 = width / 2, height / 2
    dx, dy = c * -x0 + s * -y0 + x0, -s * -x0 + c * -y0 + y0
    corners = ((F.lit(0), F.lit(0)), (width, F.lit(0)), (width, height), (F.lit(0), height))
    xs, ys = [c * x + s * y + dx for x, y in corners], [-s * x + c * y + dy for x, y in corners]
    span = lambda v: F.ceil(F.greatest(*v)) - F.floor(F.least(*v))
    pair = lambda a, b: F.struct(a.cast("long").alias("width"), b.cast("long").alias("height"))
    return F.when(millidegrees.isin(0, 180_000), pair(width, height)).when(millidegrees.isin(90_000, 270_000), pair(height, width)).otherwise(pair(span(xs), span(ys)))


def best_dpi(page_width: Column, page_height: Column, wanted: int, least: int, most_side: int, most_pixels: int) -> Column:
    """The greatest whole resolution up to wanted at which the page (of positive sides) keeps within both limits; null if none from least on does."""

    def fits(dpi: Column) -> Column:
        w, h = F.ceil(page_width * dpi / 72), F.ceil(page_height * dpi / 72)
        return (F.greatest(w, h) <= most_side) & (w * h <= most_pixels)

    # a page only grows with its resolution, so that halving finds the last one that fits
    below = min(wanted, least) - 1
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((wanted - below).bit_length()))))
    best = F.aggregate(steps, F.lit(below), lambda at, step: F.when((at + step <= wanted) & fits(at + step), at + step).otherwise(at))
    return F.when(best > below, best)
