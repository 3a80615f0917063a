import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import anchors, events, intervals, ordinals, reconcile, review


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path, ok",
    [("a/b.tex", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("C:/a", False), ("a\\b", False), ("con.tex", False), ("a.", False), ("ä/ü.bib", True)],
)
def test_safe_path(spark, path, ok):
    assert value(spark, T.safe_path(F.lit(path))) == ok


def test_roles_lengths_versions_times(spark):
    assert [value(spark, T.role_of(F.lit(p))) for p in ("x.tex", "a/x.CLS", "x.bib", "x", "x.png")] == ["tex", "class", "bibliography", "other", "image"]
    assert [value(spark, T.micro_bp(F.lit(x))) for x in ("1in", "1 bp", "72.27pt", "2.54cm", "25.4 mm", "3em")] == [72000000, 1000000, 72000000, 72000000, 72000000, None]
    assert value(spark, T.version_parts(F.lit("1.20.3-rc.1"))) == Row(major=1, minor=20, patch=3)
    assert value(spark, T.version_parts(F.lit("1.02.3"))) is None
    assert value(spark, T.zoned_timestamp(F.lit("2024-01-02T03:04:05"))) is None
    assert value(spark, T.zoned_timestamp(F.lit("2024-01-02T03:04:05Z"))) is not None


def test_comments_and_marks(spark):
    for line, want in (("a % b", "a "), (r"a \% b % c", r"a \% b "), (r"\\% x", r"\\"), ("none", "none"), ("%", "")):
        assert value(spark, T.strip_comment(F.lit(line))) == want
        assert len(value(spark, T.mask_comment(F.lit(line)))) == len(line)
    assert value(spark, T.html_escape(F.lit("<a b='c\">&"))) == "&lt;a b=&#x27;c&quot;&gt;&amp;"
    assert value(spark, T.html_escape(F.lit(None).cast("string"))) == "—"
    assert value(spark, T.dashes(F.lit("a---b--c-d"))) == "a—b–c-d"
    assert value(spark, T.redacted(F.lit("/srv/data/x /srv/y"), ["/srv", "/srv/data"])) == "<root>/x <root>/y"
    assert value(spark, T.bookmark_name(F.lit("fig:a b"))) == "fig_a_b"
    assert value(spark, T.clamp(F.lit(9), F.lit(2), F.lit(5))) == 3


def test_privacy_offsets_are_bytes(spark):
    text = "ü a@b.co, /home/me/x C:\\Users\\me\\y sk-abcdefghijklmnop1234 -----BEGIN RSA PRIVATE KEY-----"
    for pattern in T.PRIVACY_RULES.values():
        found = value(spark, T.matches_with_offsets(F.lit(text), pattern))
        assert len(found) == 1
        raw = text.encode()
        assert raw[found[0]["start_byte"] :].startswith(found[0]["value"].encode())


def test_greedy_pairs_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice("ab")) for g in range(60) for k in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g long, k long, x string")
    got = {(r["g"], r["k"]) for r in events.adjacent_pairs(df, ["g"], ["k"], F.col("x") != F.col("next.x")).filter("pair_start").collect()}
    want = set()
    for g in range(60):
        own = [r for r in rows if r[0] == g]
        k = 0
        while k + 1 < len(own):
            if own[k][2] != own[k + 1][2]:
                want.add((g, k))
                k += 1
            k += 1
    assert got == want


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, s := rng.randrange(0, 3000), s + rng.choice([0, 0, 1, 50, 2000])) for i in range(150)]
    df = spark.createDataFrame(rows, "path long, id long, start long, end long")

    def clash(a, b, zero):
        (_, _, s, e), (_, _, t, f) = a, b
        if not zero or (s < e and t < f):
            return max(s, t) < min(e, f)
        return s == t if s == e and t == f else t <= s < f if s == e else s <= t < e

    for zero in (True, False):
        want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and clash(a, b, zero))
        assert rows_of(intervals.overlap_pairs(df, zero, bin_width=100)) == want
        hit = {x for _, a, b in want for x in (a, b)}
        for width in (100, 1 << 16):
            assert {r["id"] for r in intervals.flagged(df, zero, width).collect() if r["clash"]} == hit


def test_locate_and_contiguity(spark):
    seg = spark.createDataFrame(
        [("a", 0, 0, 4, 10, 14, True), ("a", 1, 4, 6, 20, 29, False), ("a", 2, 6, 8, 29, 31, True)],
        "path string, ix int, review_start int, review_end int, source_start int, source_end int, identity boolean",
    )
    points = spark.createDataFrame([("a", p) for p in (0, 3, 4, 5, 6, 7, 8, 9)], "path string, point int")
    got = intervals.locate(points, seg).withColumn("source", intervals.source_place(F.lit("abcdefgh"), F.col("point"), F.col("segment")))
    assert {r["point"]: (r["segment"] and r["segment"]["ix"], r["source"]) for r in got.collect()} == {
        0: (0, 10), 3: (0, 13), 4: (0, 14), 5: (1, None), 6: (1, 29), 7: (2, 30), 8: (2, 31), 9: (None, None)
    }
    spans = spark.createDataFrame([("a", 1, 0, 4), ("a", 2, 3, 5), ("a", 3, 5, 5), ("a", 4, 4, 4), ("a", 5, 6, 8)], "path string, id int, start int, end int")
    assert rows_of(intervals.first_lossy(spans, seg)) == [("a", 2, 1), ("a", 3, 1)]
    cover = spark.createDataFrame([("a", 0, 0, 4, 9), ("a", 1, 5, 9, 9), ("b", 0, 0, 4, 5)], "path string, ix int, start int, end int, total int")
    assert {(r["path"], r["ix"]) for r in intervals.contiguity_violations(cover).collect()} == {("a", 1), ("b", 0)}


def test_anchors(spark):
    texts = spark.createDataFrame([(1, "one two  three four five six"), (2, "xx aaaa yy four five six seven"), (3, None), (4, "")], "doc_id long, text string")
    passages = spark.createDataFrame(
        [(1, "two three four five"), (2, "four five six"), (3, "ne two three"), (4, "nothing like this here"), (5, "aa"), (6, "o  th"), (7, ""), (8, r"\E one two")], "item_id long, text string"
    )
    got = {r["item_id"]: (r["n"], r["status"]) for r in anchors.anchor_status(passages, texts).collect()}
    again = {r["item_id"]: r["n"] for r in anchors.find_passages(passages, texts, most_short=0).groupBy("item_id").agg(F.sum("n").alias("n")).collect()}
    assert again == {k: n for k, (n, _) in got.items() if n}  # short passages by their characters
    assert got == {1: (1, "exact"), 2: (2, "conflict"), 3: (1, "exact"), 4: (0, "unmapped"), 5: (3, "conflict"), 6: (1, "exact"), 7: (0, "unmapped"), 8: (0, "unmapped")}


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "source long, target long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert rows_of(reconcile.closure(edges, roots)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert reconcile.cyclic(edges).count() >= 3
    assert reconcile.cyclic(edges.filter("source <> 3")).count() == 0


def test_markers(spark):
    m = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("c", 1, True)], "k string, at int, opens boolean")
    assert sorted(r["k"] for r in events.unbalanced(m, ["k"], "at", "opens").collect()) == ["b", "c"]
    f = spark.createDataFrame([("a", 1, "begin"), ("a", 2, "separate"), ("a", 3, "end"), ("b", 1, "end"), ("c", 1, "begin")], "k string, at int, kind string")
    assert {r["k"]: r["malformed"] for r in events.nesting(f, ["k"], "at").collect()} == {"a": False, "b": True, "c": True}
    v = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9)], "k string, at int, x int")
    assert events.not_increasing(v, ["k"], ["at"], "x").count() == 1 and events.not_increasing(v, ["k"], ["at"], "x", strict=False).count() == 0


def test_filters_and_pages(spark):
    rows = spark.createDataFrame([(k, "insertion", "exact", None) for k in range(7)], "change_id long, kind string, resolution string, decision string")
    with pytest.raises(ValueError, match="unknown filter"):
        review.matching(rows, "other")
    assert [r["change_id"] for r in review.page(rows, ["change_id"], 99, 3).collect()] == [6]
    assert [r["change_id"] for r in review.page(rows, ["change_id"], 0, 3).collect()] == [0, 1, 2]
    assert value(spark, review.initial_decision(F.lit("comment"), F.lit("exact"))) == "manual"


def test_global_ordinals_and_neighbours(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(5), k) for k in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "path long, start long").repartition(7)
    got = ordinals.with_neighbours(ordinals.numbered(df, ["path", "start"]), "start", block=50).collect()
    want = sorted(rows)
    assert sorted((r["ordinal"], r["path"], r["start"]) for r in got) == [(k, *r) for k, r in enumerate(want)]
    for r in got:
        k = r["ordinal"]
        assert r["neighbours"] == [want[j][1] for j in (k - 1, k + 1) if 0 <= j < len(want)]
