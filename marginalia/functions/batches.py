"""Rows in and out of Python in batches of bounded size, whatever a partition holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession

# Texts that a Python worker holds at once, their bytes, and the rows that it gives back at once.
MOST_TEXTS, MOST_BYTES, MOST_ROWS = 2000, 8 << 20, 4096
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_texts(spark: SparkSession) -> None:
    """Texts go to Python MOST_TEXTS or MOST_BYTES at a time, whichever is reached first; smaller settings stay."""
    rows = int(spark.conf.get(_ROWS))
    if rows <= 0 or rows > MOST_TEXTS:  # 0 and less stand for no bound
        spark.conf.set(_ROWS, MOST_TEXTS)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES))
    if size <= 0 or size > MOST_BYTES:
        spark.conf.set(_BYTES, MOST_BYTES)


def put(rows: Iterable[tuple], fields: dict[str, pa.DataType], most: int = MOST_ROWS) -> Iterator[pa.RecordBatch]:
    """rows as record batches of at most ``most`` rows; they are taken from their source only as they are put."""
    rows = iter(rows)
    while own := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*own, strict=True), fields.values(), strict=True)], names=list(fields))
