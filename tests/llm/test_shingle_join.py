"""Near duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from marginalia.llm import shingle_join

from .cases import SF, clashing, documents, empty


def brute(rows, width=5):
    """The least id of every group of (id, text)."""

    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def family(rng, n, words, most, at):
    """n copies of one text with up to ``most`` words changed."""
    text = [f"t{at}w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(text)
        for i in rng.sample(range(words), rng.randrange(most + 1)):
            own[i] = f"c{rng.randrange(9)}"
        out.append((at + k, " ".join(own)))
    return out


def test_stage_equals_brute_force_jaccard(spark):
    docs = documents(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert len(want) < docs.count()


def test_families_by_both_ways(spark):
    """Small and large families, chains of near texts, and a common line; shingles of many sets are taken the large way."""
    rng = random.Random(3)
    rows = family(rng, 60, 200, 6, 0) + family(rng, 60, 60, 3, 1000) + family(rng, 40, 12, 2, 2000) + [(3000, None), (3001, " "), (3002, "a b"), (3003, "A  b")]
    chain = [f"k{i}" for i in range(140)]
    rows += [(4000 + k, " ".join(chain[2 * k : 2 * k + 90])) for k in range(20)]
    line = " the same line of ten words that stands in many texts"
    rows += [(5000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + line) for k in range(50)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bucket, slot in ((64, 256), (4, 3)):
        assert sorted(r["doc_id"] for r in shingle_join.keep_one(docs, 5, bucket=bucket, slot=slot).collect()) == want


def test_defined_cases(spark):
    kept = shingle_join.keep_one(clashing(spark))
    assert kept.columns == clashing(spark).columns
    assert [r["text"] for r in kept.collect() if r["doc_id"] == 7] == ["same id, other text"]  # the other is near document 6
    assert shingle_join.keep_one(empty(spark)).count() == 0


def test_a_family_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """150 copies of one text, of which most are too far from each other to link; those with the fewest changes link the others."""
    rng = random.Random(5)
    rows = family(rng, 150, 146, 3, 0)
    want = brute(rows)
    made = []

    def counted(joined, real=shingle_join._pairs):
        found = real(joined)
        made.append(found.count())
        return found

    monkeypatch.setattr(shingle_join, "_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingle_join.keep_one(docs, 5).collect()) == want
    assert len(made) == 3 and made[2] < 10 * len(rows)
