"""op13: linked documents against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import jaccard_regions as jr

from .cases import CLASHING, clashing, empty, odd, odd_rows, rows_of


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain(rows, share=85):
    """(id, size, least id of the component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def joined(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return rows_of(jr.jaccard_join(df, **how), "doc_id", "n_shingles", "component_id")


def family(seed, base=80, copies=40, most=14):
    """Copies of one text with few to many changed words, so that some reach each other only through others."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(500)}" for _ in range(base)]
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(5)}"
        out.append(" ".join(own))
    return out


def mixed(seed):
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(12))
    texts = family(seed) + family(seed + 50, base=30, copies=20, most=3)
    texts += [line + " " + " ".join(f"s{rng.randrange(10_000)}" for _ in range(40)) for _ in range(30)]
    texts += [texts[0].upper()] * 15 + ["", None, " \n", "one two", "One two", "one two three", "one two three four"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", [{}, {"bucket": 1, "slot": 5}, {"bucket": 2, "rounds": 1, "slot": 3}, {"bucket": 3, "rounds": 0}])
def test_join_against_all_pairs(spark, seed, how):
    rows = mixed(seed)
    assert joined(spark, rows, **how) == plain(rows)


def test_similarity_of_exactly_85_percent(spark):
    """17 of 20 shingles link, 16 of 19 don't."""
    a = [f"a{i}" for i in range(20)]
    b = a + ["b1", "b2", "b3"]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    assert [len(shingles(t)) for _, t in rows] == [17, 20]
    assert joined(spark, rows) == [(1, 17, 1), (2, 20, 1)] == plain(rows)
    rows = [(1, " ".join(a[:19])), (2, " ".join(b[:22]))]
    assert joined(spark, rows) == [(1, 16, 1), (2, 19, 2)] == plain(rows)


def test_windows_hold_all_partners():
    """What the triangle inequality excludes can't be linked: distances are those of a metric."""
    rng = random.Random(3)
    sets = [set(rng.sample(range(30), rng.randrange(15, 30))) for _ in range(40)]

    def d(x, y):
        return 1 - len(x & y) / len(x | y)

    for p in sets[:5]:
        for x in sets:
            for y in sets:
                if d(x, p) <= 0.15 and d(x, y) <= 0.15:
                    assert d(y, p) <= 0.3 + 1e-9 and abs(d(x, p) - d(y, p)) <= 0.15 + 1e-9


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_rows()]
    assert rows_of(jr.jaccard_join(odd(spark)), "doc_id", "n_shingles", "component_id") == plain(rows)
    assert rows_of(jr.jaccard_join(clashing(spark).withColumns({c: F.lit("x") for c in ("s0", "n", "key", "h", "body")})), "doc_id", "n_shingles", "component_id") == plain(rows)
    assert "key" in CLASHING
    assert jr.jaccard_join(empty(spark)).count() == 0
