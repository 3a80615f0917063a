"""Units of a LaTeX text that may be edited: whole plain paragraphs, and islands of plain text within lines that have markup.

A text is read line by line. What is open at the end of a line (environments, formulas, groups, arguments of a command) is carried
to the next; a line is *proven* if nothing is open at its start and its end and all that it holds is known. Commands are known by
the number of their arguments. An unknown command on the level of the text ends all proofs of its file, and so does an end without its
beginning; inside an argument it spoils its line only. The islands of a proven line are what is left outside commands, formulas, groups and
special characters, and the arguments of commands that only set text. A file that isn't proven to its end has no islands at all.

Blocks of lines are windows; the reader gives lines, their proofs and their islands as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import bound_texts, put
from ..functions.text import plain_candidate
from .latex import group_end

# Commands that only set the text of their argument, and all known commands by their number of mandatory arguments.
SET_TEXT = ("emph", "textbf", "textit", "textnormal", "textrm", "textsc", "textsf", "textsl", "texttt", "textup", "underline")
WITHOUT_ARGUMENT = ("cormark", "linenumbers", "maketitle", "nolinenumbers", "printcredits")
WITH_ONE = (
    "Cref", "acrfull", "acrlong", "acrshort", "autocite", "autoref", "caption", "cite", "citeauthor", "citep", "citet", "citeyear", "cref", "eqref", "footcite",
    "footnote", "gls", "includegraphics", "index", "label", "nocite", "pageref", "parencite", "ref", "section", "subsection", "subsubsection", "supercite",
    "textcite", "url", "vref", "affiliation", "author", "cortext", "credit", "ead", "shortauthors", "shorttitle", "title", "bibliography", "bibliographystyle",
    "figref", "tblref", "added", "deleted", "add", "delete",
)
WITH_TWO = ("href", "textcolor", "replaced")
SYMBOLS = "\\%$#_{}&~^ ,;:!/"
ARGUMENTS = {**dict.fromkeys(SET_TEXT + WITH_ONE, 1), **dict.fromkeys(WITHOUT_ARGUMENT, 0), **dict.fromkeys(WITH_TWO, 2)}

_TOKEN = re.compile(r"\\(?P<edge>begin|end)\s*\{(?P<env>[A-Za-z*]+)\}|\\(?P<name>(?:[^\W\d_]|@)+|.)|\\\Z|(?P<math>\$\$?)|(?P<mark>[{}\[\]])", re.S)
_SPLIT = re.compile(r"\\(?P<name>(?:[^\W\d_]|@)+|.)\*?|(?P<math>\$\$?)|--|``|''|[{}&#_^~]", re.S)
# what a match of the two can begin with; a class alone is searched several times faster
_TOKEN_START, _SPLIT_START = re.compile(r"[\\${}\[\]]"), re.compile(r"[\\$\-`'{}&#_^~]")
_COMMENT = re.compile(r"(?<!\\)(?:\\\\)*%")
_END = re.compile(r"\r\n|\r|\n")
_FORMULA = {"$": "$", "$$": "$$", "(": "\\)", "[": "\\]"}


class Reader:
    """What is open where a text has been read to."""

    def __init__(self, inside: bool):
        self.inside, self.expected = inside, inside
        self.environments: list[str] = []
        self.formula = self.group = self.formula_inside = None
        self.depth = self.missing = self.braces = self.brackets = 0
        self.unknown = self.broken = self.over = False
        self.odd = self.edged = False  # of the present line

    def calm(self) -> bool:
        return self.inside and self.at_rest()

    def at_rest(self) -> bool:
        is_open = self.environments or self.formula or self.group or self.formula_inside or self.missing or self.braces or self.brackets
        return not (is_open or self.unknown or self.broken or self.over)

    def closed(self) -> bool:
        return self.at_rest() and not self.odd and self.inside == self.expected

    def line(self, text: str) -> bool:
        """Read a line without its comment; whether it is proven."""
        began, self.edged, at = self.calm(), False, 0
        while at < len(text) and not (self.broken or self.over):
            at = self._in_argument(text, at) if self.missing or self.group else self._in_formula(text, at) if self.formula else self._in_text(text, at)
        proven = began and self.calm() and not self.edged and not self.odd
        if self.at_rest():
            self.odd = False
        return proven

    def _in_formula(self, text: str, at: int) -> int:
        m = re.compile(r"\\.|\$\$?", re.S).search(text, at)
        if not m:
            return len(text)
        if self.formula == "$" and m[0] == "$$":
            self.broken = True
        elif m[0].startswith(self.formula):
            at = m.start() + len(self.formula)
            self.formula = None
            return at
        return m.end() if m[0][0] == "\\" else m.start() + 1

    def _in_argument(self, text: str, at: int) -> int:
        """On to the end of the group that is open, or to the beginning of the next."""
        if not self.group:
            at += len(text[at:]) - len(text[at:].lstrip())
            if at < len(text) and text[at] in "[{":
                self.group, self.depth = text[at], 0
            elif at < len(text):
                self.unknown, self.missing = True, 0
            return at
        closing = "}" if self.group == "{" else "]"
        for m in _TOKEN.finditer(text, at):
            token, name = m[0], m["name"]
            if token[0] == "\\":
                if self.formula_inside and token == self.formula_inside:
                    self.formula_inside = None
                elif not self.formula_inside and name in ("(", "["):
                    self.formula_inside = _FORMULA[name]
                elif name is None or name not in SYMBOLS:
                    self.odd = True
            elif m["math"]:
                if self.formula_inside is None:
                    self.formula_inside = token
                elif self.formula_inside == token:
                    self.formula_inside = None
                else:
                    self.odd = True
            elif token == self.group and not (self.formula_inside):
                self.depth += 1
            elif token == closing and not self.formula_inside:
                self.depth -= 1
                if not self.depth:
                    self.missing -= self.group == "{"
                    self.group = None
                    return m.end()
        return len(text)

    def _in_text(self, text: str, at: int) -> int:
        start = _TOKEN_START.search(text, at)
        if not start:
            return len(text)
        m = _TOKEN.match(text, start.start())
        token, name = m[0], m["name"]
        if m["edge"]:
            self.edged = True
            self._environment(m["edge"], m["env"])
        elif token[0] == "\\" and (name is None or name in ("begin", "end")):
            self.broken = True
        elif name == "endinput":
            self.over = self.edged = True
        elif self.environments or not self.inside:
            pass
        elif m["math"]:
            self.formula = token
        elif name in ("(", "["):
            self.formula = _FORMULA[name]
        elif name in (")", "]"):
            self.broken = True
        elif name in ARGUMENTS:
            self.missing = ARGUMENTS[name]
            return m.end() + (text[m.end() : m.end() + 1] == "*")
        elif name is not None:
            self.unknown |= name not in SYMBOLS
        elif token in "{}":
            self.braces += 1 if token == "{" else -1
            self.broken |= self.braces < 0
        else:
            self.brackets = max(0, self.brackets + (1 if token == "[" else -1))
        return m.end()

    def _environment(self, edge: str, name: str) -> None:
        if name == "document":
            self.broken |= bool(self.environments) or self.inside == (edge == "begin")
            self.inside = edge == "begin"
        elif self.inside and edge == "begin":
            self.environments.append(name)
        elif self.inside:
            self.broken |= not self.environments or self.environments.pop() != name


def islands(line: str) -> list[tuple[int, int]] | None:
    """(start, end) of the plain stretches of a proven line, without space around them; None if the line isn't understood."""
    found, at, begin = [], 0, 0

    def add(start: int, end: int) -> None:
        bare = line[start:end].strip()
        if bare:
            start += len(line[start:end]) - len(line[start:end].lstrip())
            found.append((start, start + len(bare)))

    while (start := _SPLIT_START.search(line, at)) and (m := _SPLIT.search(line, start.start())):
        add(begin, m.start())
        at, groups = m.end(), []
        if m["name"]:
            name = m["name"]
            if m[0][-1] == "*" and name not in ARGUMENTS:
                at -= 1
            while (stop := at + len(line[at:]) - len(line[at:].lstrip())) < len(line) and line[stop] in "[{" and name in ARGUMENTS:
                if sum(line[g] == "{" for g, _ in groups) == ARGUMENTS[name] or not (close := group_end(line, stop)):
                    break
                groups.append((stop, close))
                at = close
            mandatory = [g for g in groups if line[g[0]] == "{"]
            if name in _FORMULA:
                close = line.find(_FORMULA[name], at)
                if close < 0:
                    return None
                at = close + 2
            elif len(mandatory) != ARGUMENTS.get(name, 0) or (name not in ARGUMENTS and name not in SYMBOLS):
                return None
            if name in SET_TEXT:
                add(mandatory[0][0] + 1, mandatory[0][1] - 1)
        elif m["math"]:
            close = re.compile(r"(?<!\\)" + re.escape(m[0])).search(line, at)
            if not close:
                return None
            at = close.end()
        elif m[0] == "{":
            close = group_end(line, m.start())
            if not close:
                return None
            at = close
        begin = at
    add(begin, len(line))
    return found


def _lines(text: str, whole: bool) -> tuple[list[tuple[int, int, str, bool, bool, list]], bool]:
    """(number, byte offset, line, proven, commented, islands) of every line, and whether the file has islands. whole: a text of its own, whose
    document environment holds what is read."""
    reader, rows, at, allowed = Reader(not whole), [], 0, True
    ends = [m[0] for m in _END.finditer(text)] + [""]
    for ix, (line, end) in enumerate(zip(_END.split(text), ends, strict=True)):
        comment = _COMMENT.search(line) if "%" in line else None
        proven, own = reader.line(line[: comment.end() - 1] if comment else line), []
        if proven and not comment and line.strip():
            own = islands(line)
            allowed &= own is not None
        rows.append((ix, at, line, proven, comment is not None, [(at + len(line[:a].encode()), at + len(line[:b].encode()), line[a:b]) for a, b in own or ()]))
        at += len(line.encode()) + len(end)
    return rows, allowed and reader.closed()


def line_rows(texts: DataFrame, whole: bool = True) -> DataFrame:
    """(path, ix, at, line, proven, commented, islands) of the lines of texts (path, text); at and islands are in bytes."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    fields = {"path": pa.int64(), "ix": pa.int64(), "at": pa.int64(), "line": pa.string(), "proven": pa.bool_(), "commented": pa.bool_(), "islands": pa.list_(span)}

    def of(path: int, text: str) -> Iterator[tuple]:
        rows, allowed = _lines(text, whole)
        return ((path, *row, [dict(zip(("start", "end", "text"), x, strict=True)) for x in own] if allowed else []) for *row, own in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from put((row for path, text in zip(batch.column(0), batch.column(1), strict=True) for row in of(path.as_py(), text.as_py() or "")), fields)

    bound_texts(texts.sparkSession)
    return texts.select(F.col("path").cast("long"), "text").mapInArrow(run, "path long, ix long, at long, line string, proven boolean, commented boolean, islands array<struct<start:long,end:long,text:string>>")


def units(texts: DataFrame, whole: bool = True) -> DataFrame:
    """(path, start, end, kind) in bytes: blocks of proven plain lines (paragraph), and the islands of all other proven lines (island).

    Blank lines, lines that aren't proven and lines that begin with a command end a block; all but blank ones also take away the block they
    end. A line with a comment or with other markup takes away the block it stands in."""
    rows = line_rows(texts, whole)
    space = r"^\s+|\s+$"
    bare = F.regexp_replace("line", space, "")
    kind = (
        F.when(F.col("commented"), "comment").when(bare == "", "blank").when(~F.col("proven"), "unproven").when(plain_candidate(bare), "plain").when(bare.startswith("\\"), "command").otherwise("markup")
    )
    lead = F.octet_length("line") - F.octet_length(F.regexp_replace("line", r"^\s+", ""))
    unit = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    # texts end here: only places are moved
    own = F.transform(F.filter("islands", lambda i: plain_candidate(i["text"])), lambda i: unit(i["start"], i["end"], "island"))
    first = F.col("at") + lead
    rows = rows.select("path", "ix", kind.alias("kind"), first.alias("first"), (first + F.octet_length(bare)).alias("last"), own.alias("own"))
    w = Window.partitionBy("path").orderBy("ix")
    stops = F.count_if(F.col("kind").isin("blank", "command", "unproven")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    plain = F.col("kind") == "plain"
    # a block that isn't spoilt has plain and blank lines only, so it is a paragraph and nothing else
    blocks = rows.withColumn("block", F.coalesce(stops, F.lit(0))).groupBy("path", "block").agg(
        F.min(F.when(plain, F.col("first"))).alias("start"),
        F.max(F.when(plain, F.col("last"))).alias("end"),
        F.bool_or(F.col("kind").isin("comment", "markup", "command", "unproven")).alias("spoilt"),
        F.flatten(F.collect_list(F.when(F.size("own") > 0, F.col("own")))).alias("own"),
    )
    found = F.when(F.col("spoilt"), F.col("own")).when(F.col("start").isNotNull(), F.array(unit(F.col("start"), F.col("end"), "paragraph")))
    return blocks.select("path", F.inline(found))
