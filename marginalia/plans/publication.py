"""Queries that publish: each writes to a new folder below the shared one, and says what became of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..sinks import publish
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query(
    """SELECT 1 AS attempt, 'written' AS outcome, count(*) AS n FROM conversations UNION ALL SELECT 2, 'refused', count(*) FROM conversations"""
)
def no_clobber_write(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K2: the second writer is refused and changes nothing."""
    path, rows = _folder(spark, "once"), _turns(spark, sf)
    out = [(k, publish.write_new(r, path), spark.read.parquet(path).count()) for k, r in ((1, rows), (2, rows.limit(1)))]
    return spark.createDataFrame(out, "attempt int, outcome string, n long")


@query("SELECT * FROM (VALUES (1, 'written'), (2, 'reused'), (3, 'conflict')) AS t(attempt, outcome)")
def idempotent_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The same result is taken up again, another one is a conflict."""
    path, rows = _folder(spark, "apply"), _turns(spark, sf)
    changed = rows.withColumn("sha256", F.when((F.col("conv_id") == 0) & (F.col("turn") == 0), F.lit("x")).otherwise(F.col("sha256")))
    return spark.createDataFrame([(k, publish.apply_once(r, path, ["conv_id", "turn"])) for k, r in ((1, rows), (2, rows.repartition(3)), (3, changed))], "attempt int, outcome string")


@query("SELECT source, count(*) AS files, count(*) FILTER (doc_id % 9 = 4 OR doc_id % 11 = 5) AS drifted FROM documents GROUP BY source")
def immutable_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot in a folder for each source, scanned again and compared with what is there later: some files have changed, some are gone."""
    path = _folder(spark, "snapshot")
    files = table(spark, sf, "documents").select("source", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    publish.write_new(files, path, ["source"])
    later = files.filter("doc_id % 11 != 5").withColumn("sha256", F.when(F.col("doc_id") % 9 == 4, F.lit("other")).otherwise(F.col("sha256")))
    status = reconcile.differences(later, spark.read.parquet(path), ["doc_id", "source"], ["sha256"])
    return status.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("status") != "same").alias("drifted"))


@query(
    """WITH h AS (SELECT sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 1)
    SELECT 'sha256:' || h AS sha256, CASE left(h, 1) WHEN 'a' THEN 'changed' WHEN 'b' THEN 'missing' WHEN 'c' THEN 'unexpected' ELSE 'same' END AS status, CASE WHEN left(h, 1) <> 'b' THEN copies END AS copies FROM h"""
)
def returned_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Each content once, and its hash checked against the manifest. By the first digit of their hashes some contents are broken in the
    archive, some have been lost from it, some aren't in the manifest."""
    path, returned = _folder(spark, "archive"), _folder(spark, "returned")
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    publish.archive(files, path)
    digit = F.substring("sha256", 1, 1)
    stored = spark.read.parquet(path).filter(digit != "b").withColumn("content", F.when(digit == "a", F.lit(b"broken")).otherwise(F.col("content")))
    publish.write_new(stored, returned)
    manifest = files.select(F.sha2("content", 256).alias("sha256")).filter(digit != "c")
    joined = publish.verified_archive(spark, returned, manifest).join(spark.read.parquet(returned).select("sha256", "copies"), "sha256", "left")
    return joined.select(F.concat(F.lit("sha256:"), "sha256").alias("sha256"), "status", "copies")


@query(
    r"""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS removed, CAST(2 AS BIGINT) AS added FROM documents WHERE text <> ''"""
)
def unified_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The first line is changed and one is added before it; the patches of a thousand ids are one, taken apart again."""
    d = table(spark, sf, "documents").filter("text <> ''").select(F.col("doc_id").alias("path"), F.col("text").alias("before"))
    first = F.split("before", "\n", -1)
    rest = F.slice(first, F.lit(2), F.size(first))
    after = F.array_join(F.concat(F.array(F.lit("new line 1"), F.concat(F.get(first, F.lit(0)), F.lit(" changed\u2042"))), rest), "\n")
    diffs = publish.unified_diffs(d.withColumn("after", after))
    number = F.col("path").cast("long")
    patches = diffs.groupBy(F.floor(number / 1000).alias("patch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), "diff"))), lambda x: x["diff"]), "").alias("diff"))
    rows = patches.select(F.explode(publish.diff_sections(F.col("diff"))).alias("s"))
    starts = lambda mark: F.size(F.filter(F.slice(F.split("s.section", "\n"), 3, 1 << 30), lambda x: x.startswith(mark))).cast("long")
    return rows.select("s.path", starts("-").alias("removed"), starts("+").alias("added"))
