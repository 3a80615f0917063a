"""What executors hold at once: batches on their way to Python, and blocks of Parquet."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marginalia.llm import common


def texts(spark, n):
    """n texts of 30 KB that don't compress, in one partition."""
    parts = F.concat(*(F.sha2(F.concat("id", F.lit(f":{k}")), 512) for k in range(240)))
    return spark.range(0, n, 1, 1).select("id", parts.alias("text"))


def test_batches_and_blocks_are_bounded_by_their_bytes(spark):
    before = {k: spark.conf.get(k) for k in (common.BATCH_KEY, common.BYTES_KEY, common.READER_KEY)}
    try:
        written = common.materialize(texts(spark, 1500), "wide")
        assert written.count() == 1500
        groups = [pq.ParquetFile(f).metadata for f in Path(written.stored_at.removeprefix("file:")).glob("*.parquet")]
        assert max(g.row_group(k).total_byte_size for g in groups for k in range(g.num_row_groups)) < 16 << 20
        size = lambda batch: pa.record_batch({"n": pa.array([batch.num_rows]), "size": pa.array([batch.nbytes])})
        sizes = common.map_batches(written, size, "n long, size long").collect()
        assert sum(r["n"] for r in sizes) == 1500
        assert max(r["size"] for r in sizes) < 1200 * 1024
        assert spark.conf.get(common.READER_KEY) == str(common.READER_ROWS)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_smaller_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in (common.BATCH_KEY, common.BYTES_KEY, common.READER_KEY)}
    try:
        small = {common.BATCH_KEY: "7", common.BYTES_KEY: "64k", common.READER_KEY: "33"}
        for k, v in small.items():
            spark.conf.set(k, v)
        common.bound_batches(spark)
        assert {k: spark.conf.get(k) for k in small} == small
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
