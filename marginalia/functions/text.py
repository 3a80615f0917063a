"""Column functions over texts, bytes, offsets and paths. All stay in the JVM, without Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.split() takes as white space.
SPACE = r"[\x1c-\x1f\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The number of files that a project may have.
MOST_FILES = 2048
LINE_END = r"\r\n|\n|\r"
# What the privacy scan looks for.
PRIVACY_RULES = {
    "api-key": r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "posix-home": r"/(?:home|Users)/[^/\s]+",
    "private-key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "windows-profile": r"[A-Za-z]:\\Users\\[^\\\s]+",
}
#: Of each rule, words one of which stands in every match.
PRIVACY_NEEDS = {"api-key": ("sk-", "pk-", "rk-"), "email": ("@",), "posix-home": ("/home/", "/Users/"), "private-key": (" PRIVATE KEY-----", "-----BEGIN PRIVATE"), "windows-profile": (":\\Users\\",)}
# Names that Windows reserves for devices.
RESERVED = r"(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?"
# File extensions by role.
ROLES = {"tex": "tex", "ltx": "tex", "cls": "class", "sty": "style", "bst": "style", "bib": "bibliography"}
ROLES |= dict.fromkeys(("png", "jpg", "jpeg", "pdf", "eps", "svg"), "image")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body: what stands inside a lambda would else be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(text: Column) -> Column:
    """Runs of white space become one space; none stays at either end."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def tagged_sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 128 bits of the SHA-256 of the parts, written as a JSON array of strings."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(utf8(F.to_json(F.array(*(p.cast("string") for p in parts)))), 256), 1, 32))


def anonymous_token(domain: str, value: Column) -> Column:
    """SHA-256 over the domain, a zero byte and the value."""
    return F.sha2(F.concat(utf8(F.lit(domain)), F.lit(b"\x00"), utf8(value)), 256)


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes before the character with the number chars (from 0)."""
    return F.octet_length(F.substring(text, F.lit(1), chars)).cast("long")


def line_of(prefix: Column) -> Column:
    """Line number, from 1, of the place that prefix ends at; CR, LF and CRLF end lines."""
    return (F.regexp_count(prefix, F.lit(LINE_END)) + 1).cast("long")


def column_of(prefix: Column) -> Column:
    return (F.length(F.element_at(F.split(prefix, LINE_END, -1), -1)) + 1).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def newline_style(text: Column) -> Column:
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").when(cr > 0, "cr").otherwise("none")


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def splits_word(text: Column, at: Column) -> Column:
    """True if a word character stands on both sides of the boundary before character at (from 0)."""
    word = r"[\p{L}\p{N}_]"
    return F.coalesce(F.substring(text, at, F.lit(1)).rlike(word), F.lit(False)) & (at > 0) & F.substring(text, at + 1, F.lit(1)).rlike(word)


def plain_candidate(text: Column) -> Column:
    """Text that can be edited as it is: a letter, and nothing that TeX reads as a command or a ligature."""
    return (F.length(text) > 0) & text.rlike(r"\p{L}") & ~text.rlike(r"[\\{}$&#_^~%]") & ~text.rlike("--|``|''")


def dynamic_reference(text: Column) -> Column:
    return text.rlike(r"[\\#$~{}]")


def safe_path(path: Column) -> Column:
    """A portable relative path."""
    parts = F.split(path, "/", -1)
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike(r"[. ]$") | p.rlike(f"^{RESERVED}$"))
    return ~(path.rlike(r'[\x00-\x1f\\:*?"<>|]') | path.startswith("/") | bad)


def role_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("other"))


def bookmark_name(label: Column) -> Column:
    return F.substring(F.regexp_replace(label, "[^A-Za-z0-9_]", "_"), 1, 40)


def strip_comment(line: Column) -> Column:
    """Cut at the first % that an even number of backslashes stands before."""
    # possessive, since the engine would else keep a frame for every character of a long line
    return F.regexp_replace(line, r"^((?:[^%\\]++|\\.|\\$)*+)%.*$", "$1")


def mask_comment(line: Column) -> Column:
    """The comment becomes as many spaces, so that offsets stay."""
    return F.rpad(strip_comment(line), F.length(line), F.lit(" "))


def html_escape(value: Column) -> Column:
    text = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit("—"))


def dashes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–"))


def redacted(text: Column, roots: list[str], mark: str = "<root>") -> Column:
    """Longest roots first, so that one inside another doesn't leave a rest."""
    for root in sorted(roots, key=lambda r: (-len(r), r)):
        text = F.replace(text, F.lit(root), F.lit(mark))
    return text


def version_parts(text: Column) -> Column:
    """major, minor and patch of a semantic version; null where it is none."""
    pattern = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:[-+][0-9A-Za-z.+-]+)?$"
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("999999999")).cast("long")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def zoned_timestamp(text: Column) -> Column:
    """The instant of an ISO timestamp that states its offset; null for all others."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def micro_bp(length: Column) -> Column:
    """A length in bp, pt, in, cm or mm as millionths of a big point, rounded half to even; null for others."""
    number = F.regexp_extract(length, r"^\s*(\d+(?:\.\d+)?)\s*(bp|pt|in|cm|mm)\s*$", 1)
    unit = F.regexp_extract(length, r"(bp|pt|in|cm|mm)\s*$", 1)
    # Big points in one of each unit, as fractions.
    up = F.when(unit == "in", 72).when(unit == "pt", 7200).when(unit == "cm", 7200).when(unit == "mm", 720).otherwise(1)
    down = F.when(unit == "pt", 7227).when(unit.isin("cm", "mm"), 254).otherwise(1)
    exact = F.nullif(number, F.lit("")).cast("decimal(18,6)") * (up.cast("long") * 1_000_000).cast("decimal(12,0)") / down.cast("decimal(6,0)")
    return F.bround(exact, 0).cast("long")


def clamp(value: Column, start: Column, end: Column) -> Column:
    """value relative to start, kept within start and end."""
    return F.greatest(F.lit(0), F.least(value, end) - start)


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start_byte, value>> of all matches: the bytes before a match are those of the pieces and matches before it."""
    none = F.array().cast("array<struct<start_byte:bigint,value:string>>")

    def collect(p: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            at = acc["at"] + F.octet_length(F.get(p["gaps"], k))
            value = F.get(p["found"], k)
            return F.struct(
                (at + F.octet_length(value)).cast("long").alias("at"),
                F.array_append(acc["out"], F.struct(at.cast("long").alias("start_byte"), value.alias("value"))).alias("out"),
            )

        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), start, step)["out"]

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(parts, lambda p: F.when(F.size(p["found"]) > 0, collect(p)).otherwise(none))


def context_fingerprint(path: Column, raw: Column, start: Column, end: Column, reach: int = 32) -> Column:
    """Hash over a file's path and hash and over the hashes of up to ``reach`` bytes before start and after end."""
    before = F.substring(raw, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    after = F.substring(raw, end + 1, F.lit(reach))
    parts = F.struct(tagged_sha256(raw).alias("file_sha256"), path.alias("path"), tagged_sha256(before).alias("prefix"), tagged_sha256(after).alias("suffix"))
    return tagged_sha256(utf8(F.to_json(parts)))


def findings(text: Column, rules: dict[str, str]) -> Column:
    """array<struct<rule, start_byte, value>> of all matches of all rules. A rule is matched in full only where it is found at all; where its
    matches need one of a few words (PRIVACY_NEEDS), these are looked for first, which is far cheaper than the rule."""
    none = F.array().cast("array<struct<rule:string,start_byte:bigint,value:string>>")

    def named(rule: str, pattern: str) -> Column:
        found = F.transform(matches_with_offsets(text, pattern), lambda m: F.struct(F.lit(rule).alias("rule"), m["start_byte"].alias("start_byte"), m["value"].alias("value")))
        needs = PRIVACY_NEEDS.get(rule, ()) if pattern == PRIVACY_RULES.get(rule) else ()
        there = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in needs)) & text.rlike(pattern) if needs else text.rlike(pattern)
        return F.when(there, found).otherwise(none)

    return F.concat(*(named(rule, pattern) for rule, pattern in rules.items()))


def canonical_rows(row: Column, order: Column) -> Column:
    """Aggregate: the rows' JSON in order, as one JSON array, hashed. row: a struct whose fields stand in sorted order.

    The value is defined over the whole array, so a group is gathered: it must be one project's tree. A group of more than MOST_FILES
    rows fails instead of filling a task."""
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.to_json(row).alias("j"))))
    whole = tagged_sha256(utf8(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]"))))
    return F.when(F.count(F.lit(1)) <= MOST_FILES, whole).otherwise(F.raise_error(F.lit(f"a tree of more than {MOST_FILES} files")).cast("string"))
