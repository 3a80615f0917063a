import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken

from marginalia.llm import bin_packing, bpe_matrix, entries, mtree_topk

from .cases import SF, clashing, documents, empty, odd, odd_rows, rows_of


def best(queries, rows, k):
    out = []
    for q, x in queries:
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q and len(y) == len(x)))[:k]
        out += [(q, i, v, -s) for i, (s, v) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [2, 200, 1 << 26])
def test_top_k_equals_all_pairs(spark, span):
    """span 2 makes almost all scores ties; products of 2^26 and more need more than the 53 bits of a double."""
    rng = np.random.default_rng(span)
    rows = [(k, rng.integers(-span, span + 1, 8).tolist()) for k in range(400)]
    rows += [(k, rng.integers(-span, span + 1, 3).tolist()) for k in range(400, 430)] + [rows[0], (20, rows[8][1]), (7, rows[8][1]), (440, [0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [r for r in rows if r[0] % 20 == 0]  # 0 twice the same, 20 with two vectors
    got = mtree_topk.top_k(df.filter("vec_id % 20 = 0"), df, 7, per_block=90, per_query_block=8, together=2)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == best(queries, rows, 7)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1 << 31, 1 << 31]), (1, [1 << 31, 5])], "vec_id long, v array<long>")
    with pytest.raises(ValueError, match="exceed 64 bits"):
        mtree_topk.top_k(df, df)


def test_bounds_prune_clustered_vectors():
    """Of 40 tight clusters a query multiplies few rows, and of every page it skips the stored bounds say why."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    rows = np.floor(64 * (centres[rng.integers(0, 40, 8000)] + 0.02 * rng.normal(size=(8000, 32)))).astype(np.int64)
    tree = mtree_topk.MTree(np.arange(8000), rows, float((rows.astype(float) ** 2).sum(1).max()), leaf=64)
    found = tree.search(np.arange(200), rows[:200], 20, np.full(200, mtree_topk.NONE))
    assert tree.seen_rows < 0.2 * 200 * 8000 and tree.seen_pages < 0.6 * 200 * len(tree.routes)
    for i in range(0, 200, 20):
        scores = rows @ rows[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:20]
        assert [(-int(s), int(j)) for s, j in zip(*found[i], strict=True)] == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-0.5, 0.01]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS v", "'y' AS dim")
    v = mtree_topk.quantized(df, "vec_id", "embedding")
    assert rows_of(v, "vec_id", "v") == [(0, [64, 128]), (6, [-32, 0])]
    got = mtree_topk.top_k(v.filter("vec_id % 20 = 0"), v)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 6, -2048)]
    none = v.limit(0)
    assert mtree_topk.top_k(none, none).count() == 0


def naive_pack(lengths, capacities):
    """The stated rule with plain lists: least room left, oldest of equals, else the cheapest size to open."""
    longest = max(capacities)
    todo = sorted(((i, k, s, min(longest, n - s)) for i, n in enumerate(lengths) for k, s in enumerate(range(0, n, longest))), key=lambda p: (-p[3], p[0], p[1]))
    left, bins, placed = sum(p[3] for p in todo), [], []
    for i, k, s, n in todo:
        fits = [(size - used - n, b) for b, (size, used) in enumerate(bins) if used + n <= size]
        if fits:
            b = min(fits)[1]
        else:
            size = min((c for c in sorted(capacities) if c >= n), key=lambda c: (bin_packing.bin_cost(c) / min(c, left), c))
            b = len(bins)
            bins.append([size, 0])
        placed.append((i, k, s, n, b, bins[b][1]))
        bins[b][1] += n
        left -= n
    return [(i, k, s, n, b, min(c for c in capacities if c >= bins[b][1]), at) for i, k, s, n, b, at in placed]


@pytest.mark.parametrize("seed", range(10))
def test_pack_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, rng.randrange(1, 40), rng.randrange(1, 900)]) for _ in range(rng.randrange(1, 200))]
    capacities = (16, 64, 256)
    assert bin_packing.pack(lengths, capacities) == naive_pack(lengths, capacities)


def whole(rows, lengths):
    """Every document's pieces are all its tokens in order, and no bin holds more than its length."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for group in bins.values():
        assert len({r["capacity"] for r in group}) == 1
        group.sort(key=lambda r: r["place"])
        assert [r["place"] for r in group] == list(np.cumsum([0] + [r["length"] for r in group])[:-1])
        used = sum(r["length"] for r in group)
        assert min(c for c in bin_packing.CAPACITIES if c >= used) == group[0]["capacity"]
    return {k: sum(r["length"] for r in v) for k, v in pieces.items()}


def test_pack_documents(spark):
    docs = documents(spark).repartition(3)
    lengths = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert whole(bin_packing.pack_documents(docs).collect(), lengths) == lengths
    want = defaultdict(int)
    for r in odd_rows():
        want[r.doc_id] += len((r.text or "").split())
    for df in (odd(spark), clashing(spark)):
        got = bin_packing.pack_documents(df, per_round=30_000).collect()
        assert whole(got, want) == want
        assert [r["capacity"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert bin_packing.pack_documents(empty(spark)).count() == 0


def test_query_equals_tiktoken_lengths(spark):
    encoding = tokens()
    lengths = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in documents(spark).collect()}
    assert whole(entries.op10_bin_packing(spark, SF).collect(), lengths) == lengths


def test_sequences_hold_the_tokens(spark):
    """Every document's ids stand in its pieces, whole and in order; the rests of partitions share bins."""
    encoding = tokens()
    docs = documents(spark).repartition(8)
    packed = bin_packing.pack_bins(docs, tokens=entries.tokenizer(), keep_ids=True)
    rows = packed.collect()
    parts = defaultdict(list)
    for r in rows:
        assert sum(r["lengths"]) == len(r["ids"]) <= r["capacity"]
        for d, k, s, n, at in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"], r["places"], strict=True):
            parts[d].append((k, s, r["ids"][at : at + n]))
    for d in docs.collect():
        own = sorted(parts[d["doc_id"]])
        assert [k for k, _, _ in own] == list(range(len(own)))
        assert [x for _, _, ids in own for x in ids] == encoding.encode_ordinary(d["text"] or "")
    assert len({r["bin_id"] for r in rows if r["bin_id"] is not None}) == sum(r["bin_id"] is not None for r in rows)
    shares = {r["capacity"]: r["fill"] for r in bin_packing.fill(packed).collect()}
    assert all(0 < x <= 1 for x in shares.values())
    total = sum(len(r["ids"]) for r in rows)
    assert total / sum(r["capacity"] for r in rows) > 0.95


def tokens():
    path, pattern = entries.tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_matrix.load_ranks(path), special_tokens={})
