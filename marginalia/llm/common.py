"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Executors hold a whole block of Parquet while they write or read it.
BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local one is made, but only in local mode, where
    driver and executors are one process; on a cluster that would be another folder on every machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lost executors don't redo its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was made of them has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
READER_KEY, READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 512
SLICE_BYTES = 8 << 20  # where a session's batches aren't bounded by their bytes


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 2000 rows or 1 MB, whichever is reached first, and are read from Parquet 512 at a time: executors
    hold a batch several times over (columns, Arrow, what is sent), and each of their threads keeps buffers of that size. Smaller
    settings stay."""
    for key, most in ((BATCH_KEY, BATCH_ROWS), (READER_KEY, READER_ROWS)):
        now = int(spark.conf.get(key))
        if now <= 0 or now > most:  # 0 and less stand for no bound
            spark.conf.set(key, most)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BYTES_KEY))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(BYTES_KEY, BATCH_BYTES)


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces of at most ``rows`` rows and most_bytes bytes of texts; a longer text is a piece of its own."""
    if batch.num_rows <= rows and batch.nbytes <= most_bytes:
        yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = volume = 0
    for k, n in enumerate(size.tolist()):
        if k > at and (k - at == rows or volume + n > most_bytes):
            yield batch.slice(at, k - at)
            at, volume = k, 0
        volume += n
    if at < batch.num_rows:
        yield batch.slice(at)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2000) -> DataFrame:
    """Apply fn to the record batches of df, cut to at most ``rows`` rows and SLICE_BYTES bytes so that memory stays bounded."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield fn(part)

    return df.mapInArrow(run, schema)


def record_batch(columns: dict[str, tuple[Iterable, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in columns.values()], names=list(columns)
    )


def held_out(doc_id) -> Column:
    """True for the rows kept from every learning step; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key(*columns: str) -> Column:
    """16 bytes that stand for the values of the columns. 64 bits would not do: of 10^10 rows two or three would share theirs."""
    each = [F.col(c).cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each]
    return F.unhex(F.md5(F.concat(*marked).cast("binary")))


def least_hashed(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n different rows: those whose hash of the columns (by default id and text) is least, each once. Only hashes are
    sorted, so no task gathers texts. Rows are in no order."""
    by = columns or ("doc_id", "text")
    h = clean_name(rows, "_hash")
    hashed = rows.withColumn(h, F.xxhash64(*by))
    cut = hashed.select(h).distinct().orderBy(h).limit(n).agg(F.max(h)).first()[0]
    return hashed.filter(F.lit(False) if cut is None else F.col(h) <= cut).dropDuplicates([h]).drop(h)


def clean_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet (Spark takes names in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
