"""Tables that the tests of the training-data operators share."""

import random
import zlib

from pyspark.sql import Row
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# names that the operators use themselves
CLASHING = (
    "key spans _key _spans _row _kept fp h row gram start score kept n_words n_lines base_failed component_id root least "
    "_words _lines held_out bin_id capacity place toxic _id n dim block ids"
).split()


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def odd_rows():
    """Null and empty texts, null ids, ties, repeated rows, texts of every script, and a very long one."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choices(words, k=40_000))
    passage = " ".join(rng.choices(words, k=150))
    rows = [
        (1, None, None, None),
        (2, "", "en", "web"),
        (3, "   \n\t ", None, "web"),
        (4, "½ 12 345", "en", None),
        (5, long, "en", "web"),
        (6, "start " + passage + " end", "en", "web"),
        (7, "other begin " + passage, "de", "web"),
        (7, "other begin " + passage, "de", "web"),
        (7, "same id, other text", "de", "web"),
        (8, "été naïve 中文字符 كتاب 😀 x", None, "web"),
        (9, "a" * 3000, None, "web"),
        (None, "no id " + passage, None, "web"),
        (None, None, None, None),
        (10, "Password: hunter2hunter2 AKIA" + "ABCDEFGHIJKLMNOP" + " " + "0123456789abcdef" * 2, None, None),
        (11, "Under the MIT license. Apache License, Version 2. CC BY-NC under the mit license", None, None),
        (12, "one", None, None),
        (13, "one two", None, None),
        (14, "ONE two", None, None),
    ]
    return [Row(doc_id=a, text=b, lang=c, source=d, n_chars=None if b is None else len(b)) for a, b, c, d in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def clashing(spark):
    """The same rows with extra columns that carry the operators' own names."""
    return odd(spark).withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
