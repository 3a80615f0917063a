"""Repeated passages of the pipeline against a plain count of word runs."""

import random
from collections import Counter

import corpus_pipeline
from marginalia.llm import passages

from .cases import SF, clashing, documents, empty


def brute(rows, n=51):
    """The words that stay in each text, in order of the rows."""
    split = [passages.words(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def test_passages_of_short_words(spark):
    """51 words of one to three letters, far less than 400 bytes, go; 50 words stay."""
    rng = random.Random(5)
    short = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randrange(1, 4))) for _ in range(n))
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    gone, stays, chinese = short(51), short(50), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    blob = "".join(rng.choices("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijkmnop", k=1500))
    rows = [f"{own(20)} {gone} {own(30)}", f"{own(9)}\n{gone.replace(' ', '  ')}\t{own(40)}", f"{own(70)} {stays} {own(3)}", f"{stays} {own(60)}"]
    rows += [f"{own(8)} {chinese} {own(70)}", f"{own(61)}{chinese}", f"{own(60)} x{blob}", f"{blob[100:]} {own(60)}", None, "", gone.upper()]
    rows += [f"{own(5)} {gone}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert [passages.words(kept[k] or "") for k in range(len(rows))] == brute(rows)
    assert gone not in kept[0] and stays in kept[2] and stays in kept[3] and chinese[5:55] not in kept[4]
    assert len(kept[6]) < 1200 and kept[8] is None and kept[9] == ""


def test_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    kept = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    want = brute([r["text"] for r in rows])
    assert [passages.words(kept[r["doc_id"]]["text"] or "") for r in rows] == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values() if r["text"] is not None)


def test_defined_cases(spark):
    cut = passages.remove_passages(clashing(spark))
    assert cut.columns == clashing(spark).columns and cut.count() == clashing(spark).count()
    assert passages.remove_passages(empty(spark)).count() == 0
