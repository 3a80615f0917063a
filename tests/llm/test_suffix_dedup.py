import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import entries, suffix_dedup

from .cases import SCHEMA, SF, clashing, documents, empty, odd, odd_rows, rows_of

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=400):
    """rows: (doc_id, text). Every string of length bytes is counted over all texts."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        cover = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, c in zip(raw, cover, strict=False) if not c)
        out.append((d, len(raw), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    # hashes stand for the strings here, so that they fit in memory
    assert rows_of(entries.op3_suffix_dedup(spark, SF), *NAMES) == brute(texts)


def test_defined_cases(spark):
    want = brute([(r.doc_id, r.text) for r in odd_rows()])
    assert rows_of(suffix_dedup.digest(odd(spark)), *NAMES) == want
    assert rows_of(suffix_dedup.digest(clashing(spark)), *NAMES) == want
    assert suffix_dedup.digest(empty(spark)).count() == 0
    cut = suffix_dedup.remove_repeats(clashing(spark))
    assert cut.columns == clashing(spark).columns and cut.count() == clashing(spark).count()
    assert sum(r["text"] is None for r in cut.collect()) == 2


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [3, 2000])
def test_random_texts_with_shared_and_changed_passages(spark, monkeypatch, seed, bucket):
    """Near copies of one passage make large buckets of different contexts; small buckets are split."""
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcd éè中 ", k=900))
    texts = []
    for k in range(40):
        own = list(passage)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = rng.choice("xyzé")
        a = rng.randrange(0, 200)
        texts.append((k, "".join(rng.choices("abcdef", k=rng.randrange(0, 300))) + "".join(own[a:]) + "ab" * rng.randrange(0, 300)))
    docs = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in texts], SCHEMA)
    original = suffix_dedup.covered_spans
    monkeypatch.setattr(suffix_dedup, "covered_spans", lambda keyed, length, gram: original(keyed, length, gram, bucket))
    assert rows_of(suffix_dedup.digest(docs), *NAMES) == brute(texts)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array(seed):
    rng = random.Random(seed)
    symbols = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(1, 200))] + [0]
    assert suffix_dedup.suffix_array(np.array(symbols)) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_texts_stay_valid(spark):
    passage = "é中" * 200  # what goes on with the pattern repeats within its own text
    docs = spark.createDataFrame([(1, "x" + passage + "é", None, None, 1), (2, "yy" + passage + "中", None, None, 1)], SCHEMA)
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept == {1: "x", 2: "yy中"}


@pytest.mark.parametrize("size, gone", [(399, 0), (400, 400), (401, 401)])
def test_the_length_that_counts(spark, size, gone):
    """A passage of 400 bytes in two documents goes, one of 399 stays, however many words it has."""
    rng = random.Random(size)
    own = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = " ".join(own(5) for _ in range(100))[:size]
    assert len(passage.split()) > 50
    docs = spark.createDataFrame([(k, f"{own(300)}{'XYZ'[k]}{passage}{'UVW'[k]}{own(500)}", None, None, 1) for k in range(3)], SCHEMA)
    assert [r["n_removed"] for r in suffix_dedup.digest(docs).collect()] == [gone] * 3
    cut = suffix_dedup.remove_repeats(docs, length=240)  # the operator's length is free
    assert all(passage not in r["text"] for r in cut.collect())


def test_rows_that_share_64_bits_of_their_key(spark, monkeypatch):
    """Texts are told apart by 128 bits, so one text's spans never cut another."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdef ", k=600))
    rows = [(k, "".join(rng.choices("ghij", k=500)) + (passage if k < 2 else "".join(rng.choices("klmn", k=900))), None, None, 1) for k in range(6)]
    half = lambda *c: F.unhex(F.concat(F.lit("ab" * 8), F.substring(F.md5(F.concat_ws("|", *c)), 1, 16)))
    monkeypatch.setattr(suffix_dedup, "row_key", half)
    assert rows_of(suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA)), *NAMES) == brute([r[:2] for r in rows])
