"""Publication: nothing that exists is overwritten. Folders appear whole (``atomic``); what is here adds the decisions around them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import differences
from . import atomic


def write_new(rows: DataFrame, path: str, partition: list[str] | None = None) -> str:
    """written, refused if a finished folder is there already, or broken if something else is."""
    return atomic.publish(rows, path, partition)


def apply_once(rows: DataFrame, path: str, key: list[str]) -> str:
    """written, reused if the same rows are there already, or conflict if others are. A repeated job changes nothing; what a crash left half
    done, under this name or another, is no obstacle: it is moved aside. Of two jobs that run at once one writes, the other compares."""
    spark = rows.sparkSession
    if atomic.state(spark, path) != "finished" and atomic.publish(rows, path, repair=True) == "written":
        return "written"
    values = [c for c in rows.columns if c not in key]
    return "reused" if differences(spark.read.parquet(path), rows, key, values).filter("status <> 'same'").isEmpty() else "conflict"


def archive(files: DataFrame, path: str) -> str:
    """files: (path, content). Each different content is stored once, by its hash; archiving the same again is no change."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    contents = hashed.groupBy("sha256").agg(F.min("content").alias("content"), F.min("path").alias("first_path"), F.count("*").alias("copies"))
    return apply_once(contents, path, ["sha256"])


def verified_archive(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(sha256, status) of an archive against its manifest (sha256): same, missing, unexpected, or changed if a content isn't what its
    hash says."""
    stored = spark.read.parquet(path).select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("sound"))
    return differences(manifest.select("sha256").distinct().withColumn("sound", F.lit(True)), stored, ["sha256"], ["sound"])


DIFF = "path string, diff string"


def unified_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff) of the texts that changed. pairs: (path, before, after). No times, so equal inputs give equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, diffs = [], []
            for path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{path}", f"b/{path}", n=context)
                paths.append(path)
                diffs.append("".join(x if x.endswith("\n") else f"{x}\n" for x in lines))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(diffs, pa.string())], names=["path", "diff"])

    changed = pairs.filter(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(F.col("path").cast("string"), "before", "after").mapInArrow(run, DIFF)


def diff_sections(diff: Column) -> Column:
    """array<struct<path, section>> of a patch that is several files' differences, one after the other."""
    parts = F.filter(F.split(diff, r"(?m)^(?=--- a/.*\n\+\+\+ b/)", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^--- a/([^\r\n]*)", 1).alias("path"), x.alias("section")))
