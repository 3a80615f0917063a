"""Scans of file trees with Spark's binaryFile source: inventories, stable re-reads, staging totals, LaTeX text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_rows, lines, role_of, strip_comment, tagged_sha256

# LaTeX commands that name other files, and constructs that are counted.
REFERENCE = r"\\(input|include|bibliography|addbibresource|includegraphics|documentclass|usepackage)\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}"
FEATURES = {
    "citation": r"\\cite[a-z]*\*?\s*[\[{]",
    "display_math": r"\\begin\{(?:equation|align|gather|multline)\*?\}|\\\[",
    "image": r"\\includegraphics\b",
    "label": r"\\label\s*\{",
    "reference": r"\\(?:eq|page|auto)?ref\s*\{",
    "table": r"\\begin\{table\*?\}",
}
MACROS = r"\\(added|deleted|replaced|add|delete)\s*(?:\[[^\]]*\])?\s*\{"


def inventory(spark: SparkSession, root: str, most_bytes: int = 16 << 20) -> DataFrame:
    """(path, length, modified, sha256, role, too_large) of every file below root. Only files within the limit are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fits = F.col("length") <= most_bytes
    return files.select(
        "path", "length", F.col("modificationTime").alias("modified"), F.when(fits, tagged_sha256(F.col("content"))).alias("sha256"), role_of(F.col("path")).alias("role"), (~fits).alias("too_large")
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content, length or presence changed between two inventories."""
    from ..operators.reconcile import differences

    return differences(before, after, ["path"], ["length", "sha256"]).filter("status != 'same'")


def tree_hash(files: DataFrame) -> DataFrame:
    return files.agg(canonical_rows(F.struct("path", "sha256"), F.col("path")).alias("tree_hash"))


def directory_totals(files: DataFrame) -> DataFrame:
    """(dir, files, bytes) of each directory."""
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def sources(spark: SparkSession, root: str, pattern: str = "*.tex") -> DataFrame:
    """(path, text) of all text files below root that match pattern; bytes that aren't UTF-8 fail the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    valid = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.coalesce(valid, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")).alias("text"))


def uncommented(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: strip_comment(x)), "\n")


def references(texts: DataFrame) -> DataFrame:
    """(path, ix, command, name): files that a text names outside comments, lists taken apart."""
    clean = uncommented(F.col("text"))
    command, name = (F.regexp_extract_all(clean, F.lit(REFERENCE), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(command, name, lambda c, n: F.struct(c.alias("command"), n.alias("name")))
    rows = texts.select("path", F.posexplode(pairs).alias("ix", "r"))
    return rows.select("path", "ix", "r.command", F.explode(F.transform(F.split("r.name", ","), lambda x: F.trim(x))).alias("name"))


def feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, n, first_path) over all texts, outside comments."""
    clean = texts.select("path", uncommented(F.col("text")).alias("t"))
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.regexp_count("t", F.lit(p)).alias("n")) for f, p in FEATURES.items()))
    rows = clean.select("path", F.inline(each))
    return rows.groupBy("feature").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("path"))).alias("first_path"))


def macro_counts(texts: DataFrame) -> DataFrame:
    """(path, macro, n) of the revision macros."""
    found = F.regexp_extract_all(uncommented(F.col("text")), F.lit(MACROS), F.lit(1))
    return texts.select("path", F.explode(found).alias("macro")).groupBy("path", "macro").agg(F.count("*").alias("n"))
