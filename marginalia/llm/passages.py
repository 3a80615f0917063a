"""Removal of passages of more than fifty words that stand in more than one place of all texts.

A word goes if it lies in a run of ``words`` words that starts at more than one place; white space does not count. Every word
becomes a code of 64 bits (a hash), whatever its length, and the search is that of suffix_dedup over these codes: anchors, contexts
and suffix arrays of words instead of bytes.

Scripts without spaces: each Han, kana, Thai, Lao, Khmer or Burmese character is a word. A string of more than 64 characters without a
space counts as the pieces that end with one of a few characters (about eight characters each in random letters and digits).

Defined cases: as in suffix_dedup; a null text stays null. The white space around a passage stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_name, row_key
from .suffix_dedup import covered_spans, merged, repeated_unit_starts

WORDS = 51
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")
_PIECE = re.compile(r"[^-/.,;&=+_05AGMSYekqw]*[-/.,;&=+_05AGMSYekqw]|[^-/.,;&=+_05AGMSYekqw]+")
LONG = 64
_SPACED = re.compile(rf"[{_ALONE}]|\S{{{LONG + 1}}}")


def word_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _WORD.finditer(text):
        if m.end() - m.start() <= LONG:
            out.append(m.span())
        else:
            out += [p.span() for p in _PIECE.finditer(text, *m.span())]
    return out


def words(text: str) -> list[str]:
    if not _SPACED.search(text):  # the same words, sooner
        return text.split()
    return [text[a:b] for a, b in word_spans(text)]


def codes(text: str | None) -> np.ndarray:
    found = words(text or "")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield key, codes(text.as_py())


def remove_passages(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their texts cut. A null text stays null."""
    key, spans = clean_name(docs, "_key"), clean_name(docs, "_spans")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    texts = keyed.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = covered_spans(texts, words, words * 5 // 8, raw=_coded, starts=repeated_unit_starts)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, s: object) -> str | None:
            if t is None or s is None:
                return t
            places, out, at = word_spans(t), [], 0
            for first, end in merged([tuple(x) for x in s], len(places)):
                out.append(t[at : places[first][0]])
                at = places[end - 1][1]
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return keyed.join(found.toDF(key, spans), key, "left").withColumn(text, cut(F.col(text), F.col(spans))).select(*docs.columns)
