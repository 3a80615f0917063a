import random

import pytest
import xxhash

from marginalia.llm import entries, simhash_ring
from marginalia.llm.simhash_ring import components, groups, ring_links

from .cases import SF, clashing, documents, empty, odd, odd_rows, rows_of


def fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(values, budget):
    """Least member that each value reaches, over all pairs."""
    values = sorted(set(values))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= budget:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {v: root(v) for v in values}


def brute(rows, width=3, budget=2):
    marks = [(d, fingerprint(t, width)) for d, t in rows]
    of = classes([f for _, f in marks], budget)
    least = {}
    for d, f in marks:
        if d is not None:
            least[of[f]] = min(least.get(of[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(of[f])) for d, f in marks), key=repr)


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    assert rows_of(entries.op4_simhash_ring(spark, SF), "doc_id", "fingerprint", "component_id") == brute(rows)


def test_defined_cases(spark):
    want = sorted(((d, c) for d, _, c in brute([(r.doc_id, r.text) for r in odd_rows()])), key=repr)
    for docs in (odd(spark), clashing(spark)):
        assert rows_of(simhash_ring.near_duplicates(docs), "doc_id", "component_id") == want
        kept = simhash_ring.keep_one(docs, 5)
        assert kept.columns == docs.columns
        assert kept.count() == len({c for _, _, c in brute([(r.doc_id, r.text) for r in odd_rows()], 5)})
    assert simhash_ring.near_duplicates(empty(spark)).count() == 0
    assert simhash_ring.keep_one(empty(spark)).count() == 0


def test_links_in_small_and_large_buckets(spark):
    """A family around one value fills buckets beyond the size that is joined with itself; others stay small."""
    rng = random.Random(4)
    values = set()
    for centre, members in ((rng.getrandbits(64), 300), (rng.getrandbits(64), 20), ((1 << 63) | 5, 40)):
        for _ in range(members):
            v = centre
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
                v ^= 1 << bit
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    want = classes(values, 2)
    for bucket in (2, 4, 64, 100_000):
        links = ring_links(fps, 2, bucket).collect()
        assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in links)
        up = {v: v for v in values}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for r in links:
            a, b = root(r["a"] & (1 << 64) - 1), root(r["b"] & (1 << 64) - 1)
            up[max(a, b)] = min(a, b)
        assert {v: root(v) for v in values} == want
    three = {tuple(sorted((r["a"], r["b"]))) for r in ring_links(fps, 3).collect()}
    whole = {tuple(sorted((a, b))) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert three == whole


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[k] == 1000 for k in range(1001, 1100)) and got[5001] == 5000


def test_groups_without_links(spark):
    got = groups(spark.createDataFrame([(3, 0), (2, 0), (9, -1)], "doc_id long, fp long"))
    assert rows_of(got, "fp", "component_id", "n_fps") == [(-1, 9, 1), (0, 2, 1)]


@pytest.mark.parametrize("budget, fine", [(1, False), (2, False), (3, False), (2, True), (3, True)])
def test_pigeonring_keys_meet_all_linked_pairs(budget, fine):
    """Two values within the budget agree on the mask of some key from whose start all chains keep within their budgets."""
    rng = random.Random(budget)
    keys, ring = simhash_ring.ring_keys(budget, fine), simhash_ring.segments(3 * budget + 1 if fine else budget + 1)
    for _ in range(3000):
        differ = sum(1 << k for k in rng.sample(range(64), rng.randrange(budget + 1)))
        chains = lambda start: all(
            (differ & simhash_ring._chain(ring, start, n)).bit_count() <= n * budget // len(ring) for n in range(1, len(ring) + 1)
        )
        assert any(not differ & mask and chains(start) for start, mask in keys)
    assert fine is (min(mask.bit_count() for _, mask in keys) > 64 // (budget + 1) + 1)


def test_ids_that_are_all_null_keep_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash_ring.keep_one(docs).collect()) == [(0, "other words"), (4, "a b c d e f")]
