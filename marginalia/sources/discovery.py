"""Which files a project is made of: those that its main file names, those that these name, and so on.

Every round reads the files that the last one named for the first time, and no others; files that nothing names are never opened, unless all texts lie in one table. A name
becomes candidates (as it is, or with the extensions of its kind), which meet the listing of the project's names as an equi join. The
rounds end when nothing new is named, so cycles end too.

Names are found outside comments. Names with commands in them (dynamic), absolute ones, those that lead above the root (rejected), and those
that meet no file (missing) or several (ambiguous) are external references. Classes and packages without a file of their own are the
system's and no reference at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_rows, role_of, tagged_sha256
from ..operators.reconcile import checkpointed
from .files import uncommented
from .graphics import EXTENSIONS

# Commands that name files, the kind of their edges, and the extensions tried where the name alone meets no file.
COMMANDS = {
    "input": ("input", (".tex",)), "include": ("include", (".tex",)), "bibliography": ("bibliography", (".bib",)), "addbibresource": ("bibliography", (".bib",)),
    "includegraphics": ("graphic", EXTENSIONS), "documentclass": ("class", (".cls",)), "usepackage": ("package", (".sty",)),
}
TEXTS = (".tex", ".ltx", ".sty", ".cls", ".bib", ".def", ".cfg", ".fd")
_NAME = r"\\(input|include|bibliography|addbibresource|includegraphics|documentclass|usepackage)\*?\s*(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}"


def named(texts: DataFrame) -> DataFrame:
    """(project, file, kind, name, tried) of what texts (project, file, text) name; lists are taken apart."""
    clean = uncommented(F.col("text"))
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(_NAME), F.lit(1)).alias("c"), F.regexp_extract_all(clean, F.lit(_NAME), F.lit(2)).alias("n"))
    rows = texts.select("project", "file", F.explode(pairs).alias("p")).select("project", "file", F.col("p.c").alias("command"), F.explode(F.split("p.n", ",")).alias("name"))
    kind = F.element_at(F.create_map(*(F.lit(x) for c, (k, _) in COMMANDS.items() for x in (c, k))), F.col("command"))
    tried = F.element_at(F.create_map(*(x for c, (_, e) in COMMANDS.items() for x in (F.lit(c), F.array(F.lit(""), *map(F.lit, e))))), F.col("command"))
    return rows.select("project", "file", kind.alias("kind"), F.trim("name").alias("name"), tried.alias("tried")).distinct()


def resolved(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, file, kind, name, target, reason): target is the one file a name meets, or null and the reason why there is none."""
    bare = F.regexp_replace("name", r"^(?:\./)+", "")
    reason = F.when((F.col("name") == "") | F.regexp_like("name", F.lit(r"[\\#$~{}]")), "dynamic").when(
        (bare == "") | F.regexp_like(bare, F.lit(r"^/|:|(?:^|/)\.\.(?:/|$)")), "rejected"
    )
    key = ["project", "file", "kind", "name"]
    rows = names.withColumn("early", reason)
    candidates = rows.filter("early IS NULL").select(*key, F.explode(F.transform("tried", lambda e: F.concat(bare, e))).alias("target"))
    hits = candidates.join(listing.select("project", F.col("file").alias("target")), ["project", "target"]).groupBy(*key).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    met = rows.join(hits, key, "left")
    reason = F.coalesce("early", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous"))
    return met.select(*key, F.when(reason.isNull(), F.col("target")).alias("target"), reason.alias("reason")).filter("NOT (reason IS NOT NULL AND kind IN ('class', 'package') AND reason = 'missing')")


class Project:
    """files: (project, file, round). edges: (project, file, target, kind). external: (project, file, kind, name, reason)."""

    def __init__(self, files: DataFrame, edges: DataFrame, external: DataFrame):
        self.files, self.edges, self.external = files, edges, external


def discover(mains: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame] | DataFrame) -> Project:
    """mains, listing: (project, file). read gives the texts (project, file, text) of the files it is asked for, and none of other files.

    Or it is a table of all texts. A round can't open a few rows of a table but scans it whole, so there all names are taken and resolved in
    one scan, and the rounds only follow them; what isn't reached is left out in the end."""
    text = reduce(lambda a, b: a | b, (F.lower("file").endswith(e) for e in TEXTS))
    key, every = ["project", "file"], None
    if isinstance(read, DataFrame):
        every = checkpointed(resolved(checkpointed(named(read.filter(text))), listing))
    frontier = checkpointed(mains.join(listing, ["project", "file"], "left_semi").select("project", "file").distinct())
    seen, found, turn = frontier.withColumn("round", F.lit(0)), [], 0
    while not frontier.isEmpty():
        if every is None:
            met = checkpointed(resolved(named(read(frontier.filter(text))), listing))
            found.append(met)
        else:
            met = every.join(frontier, key, "left_semi")
        turn += 1
        frontier = checkpointed(met.filter("target IS NOT NULL").select("project", F.col("target").alias("file")).distinct().join(seen, ["project", "file"], "left_anti"))
        seen = seen.union(frontier.withColumn("round", F.lit(turn)))
    if every is not None:
        found = [every.join(seen, key, "left_semi")]
    none = seen.limit(0).select("project", "file", F.lit("").alias("kind"), F.lit("").alias("name"), F.lit("").alias("target"), F.lit("").alias("reason"))
    rows = reduce(DataFrame.unionByName, found, none)
    return Project(seen, rows.filter("reason IS NULL").select("project", "file", "target", "kind").distinct(), rows.filter("reason IS NOT NULL").select("project", "file", "kind", "name", "reason").distinct())


def discover_tree(spark: SparkSession, root: str, main: str, most_files: int = 2048) -> tuple[Project, DataFrame]:
    """The project of a folder's main file, and its files with (file, length, sha256, role). The listing reads names alone; contents are read
    by lists of paths. A project of more than most_files files is an error, not a part of it."""
    base = root.rstrip("/")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.substring_index("path", base + "/", -1)
    listing = checkpointed(every.select(F.lit("").alias("project"), relative.alias("file")))

    def contents(asked: DataFrame) -> DataFrame | None:
        names = [r["file"] for r in asked.select("file").limit(most_files + 1).collect()]
        if len(names) > most_files:
            raise ValueError(f"the project has more than {most_files} files")
        return spark.read.format("binaryFile").load([f"{base}/{n}" for n in names]) if names else None

    def read(asked: DataFrame) -> DataFrame:
        rows = contents(asked)
        if rows is None:
            return asked.withColumn("text", F.lit(""))
        text = F.col("content").cast("string")
        valid = F.when(F.is_valid_utf8(text), text)
        return rows.select(F.lit("").alias("project"), relative.alias("file"), F.coalesce(valid, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")).alias("text"))

    project = discover(spark.createDataFrame([("", main)], "project string, file string"), listing, read)
    rows = contents(project.files)
    if rows is None:
        raise ValueError(f"no {main} below {root}")
    return project, rows.select(relative.alias("file"), "length", tagged_sha256(F.col("content")).alias("sha256"), role_of(relative).alias("role"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash of a project's files (file, sha256); a project is bounded by the limit of its discovery."""
    return files.agg(canonical_rows(F.struct("file", "sha256"), F.col("file")).alias("tree_hash"))
