"""Join of documents by the Jaccard distance of their word shingles: pivots, Voronoi regions, windows, and recursion.

Two documents link when their sets of four-word shingles have a similarity of 85 % or more: a distance of e = 0.15 or less in a metric.
Equal sets count once. Almost all pairs of documents have nothing in common, so distances of 1 fill the space and no pivot can tell
them apart; regions are therefore drawn only where sets lie close together.

Cells. In one order of all shingles (frequent ones last, by a sample that changes the work and never the result) two linked sets share
one of the first n - ceil(0.85 n) + 1 shingles of both. The sets that have a shingle among their first are its cell. A set without a cell is
farther than e from all others.

Regions. Cells of up to ``bucket`` sets are compared pair by pair. Each larger cell takes pivots: its most central set (the one
with the most of its first shingles in cells) and a few by hash. All its sets are measured against them, up to a distance of 2e.
A set within e of a pivot is at home in that pivot's region and linked to it. By the triangle inequality its partners lie within 2e
of the pivot, and their distances to it differ by e at most: that is the window. So a region joins the sets at home with those that the
window adds, unless links join them already. All partners of a set at home are found then; it leaves the cell.

Recursion. The sets that found no home form cells of their own, with pivots of their own, ``rounds`` times. What is left then
meets pair by pair, in slots of ``slot`` sets. Nothing is capped: the rounds only decide by what way a pair is found.

Before two sets are compared as wholes, their sizes and 256 parity bits must allow the distance, then 4096 such bits: the bits differ in no
more places than the sets do, whatever they hold.

Scale. A set's shingles are written once and read by every step. Cells, pivots and distances are joined by keys and distributed; what goes
to the tasks are bitmaps of at most 64 MB that only save rows. The recursion has a fixed number of rounds. A family of near copies costs
its size times the pivots, and pairs only among those that no pivot is near.

Defined cases: a null or empty text, or one of white space, has no shingles, links with nothing and is its own component; a
text of fewer words than the width has one shingle. A very long text is taken whole. Texts are known by 128 bits of their set, shingles
by 64. Rows with equal ids or that repeat are rows of their own, of one component if they have words. A null id never names a component unless all its ids
are null. Only the id and text columns are read, whatever others are called. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, record_batch
from .shingle_join import BITS, parity, set_key, shingle_set
from .simhash_ring import components
from .suffix_dedup import Bitmap

WIDTH, SHARE = 4, 85
SAMPLE, OFTEN, PIVOTS, ROUNDS, BUCKET, SLOT = 8, 2, 3, 2, 8, 256
WIDE = 4096


def _sets(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, h, key, n, s0 to s3, wide, body): the set of each row, 256 and 4096 parity bits, and its shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
        bits = np.array([parity(s) for s in own], np.int64).reshape(-1, 4)
        return record_batch(
            {
                "doc_id": (batch.column(0), pa.int64()),
                "h": (batch.column(1), pa.int64()),
                "key": ([set_key(s) for s in own], pa.binary()),
                "n": ([len(s) for s in own], pa.int64()),
            }
            | {s: (np.ascontiguousarray(bits[:, i]), pa.int64()) for i, s in enumerate(BITS)}
            | {"wide": ([parity(s, WIDE).tobytes() for s in own], pa.binary()), "body": ([s.tobytes() for s in own], pa.binary())}
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text, F.monotonically_increasing_id()).alias("h"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, h long, key binary, n long, " + ", ".join(f"{s} long" for s in BITS) + ", wide binary, body binary")


def _shingles(batch: pa.RecordBatch, wanted: Bitmap) -> dict[bytes, np.ndarray]:
    """The different sets among the wanted rows of a batch (h, key, body)."""
    hit = pa.array(wanted.has(batch.column(0).to_numpy()))
    keys, bodies = (batch.column(i).filter(hit).to_pylist() for i in (1, 2))
    return {k: np.frombuffer(b, np.uint64) for k, b in zip(keys, bodies, strict=True) if b}


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)


def first_shingles(shingles: np.ndarray, often: Bitmap, share: int) -> np.ndarray:
    n, o = len(shingles), often.has(shingles)
    return np.concatenate([shingles[~o], shingles[o]])[: n - (share * n + 99) // 100 + 1]


def _cells(bodies: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(shingle, key, central): the sets that have a shingle among their first, where several do; central: the percentage of a
    set's first shingles that it shares."""
    wanted = Bitmap(sets, "h")

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, n = np.unique(_flat(list(_shingles(batch, wanted).values())), return_counts=True)
        return record_batch({"shingle": (shingles, pa.int64()), "n": (n, pa.int64())})

    some = bodies.filter(F.pmod("h", F.lit(SAMPLE)) == 0)
    counts = map_batches(some, sampled, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = materialize(counts.filter(F.col("n") >= OFTEN).select("shingle"), "often")
    often = Bitmap(common, "shingle")

    def first(batch: pa.RecordBatch) -> tuple[list[bytes], list[np.ndarray]]:
        own = _shingles(batch, wanted)
        return list(own), [first_shingles(s, often, share) for s in own.values()]

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, firsts = first(batch)
        short = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
        return record_batch({"shingle": (_flat(firsts), pa.int64()), "k": (np.repeat(short, [len(f) for f in firsts]), pa.int64())})

    # two sets with the same first 64 bits of their keys look like one here, unless a third shares the shingle; so rows are counted too
    seen = map_batches(bodies, spread, "shingle long, k long").groupBy("shingle").agg(F.count("*").alias("rows"))
    several = materialize(seen.filter("rows > 1").select("shingle"), "several")
    shared = Bitmap(several, "shingle")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, firsts = first(batch)
        hits = [f[shared.has(f)] for f in firsts]
        times = [len(h) for h in hits]
        central = [100 * t // max(1, len(f)) for t, f in zip(times, firsts, strict=True)]
        return record_batch(
            {
                "shingle": (_flat(hits), pa.int64()),
                "key": ([k for k, n in zip(keys, times, strict=True) for _ in range(n)], pa.binary()),
                "central": (np.repeat(np.array(central, np.int64), times), pa.int64()),
            }
        )

    cells = materialize(map_batches(bodies, place, "shingle long, key binary, central long").distinct(), "cells")
    discard(common, several)
    return cells


def _allowed(x: str, y: str, share: int) -> Column:
    """Never false for two sets with a similarity of share percent or more."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in BITS), F.lit(0))
    return (100 * F.least(n, m) >= share * F.greatest(n, m)) & ((100 + share) * differ <= (100 - share) * (n + m))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))


def _compared(bodies: DataFrame, sets: DataFrame, pairs: DataFrame, column: str, test, schema: str, name: str) -> DataFrame:
    """What test leaves of the pairs (a, b) of keys, given the column of both sets. pairs is a written table that is read no more."""
    members = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    asked = materialize(sets.join(members, "key", "left_semi").select("key", "h"), "asked")
    in_pairs = Bitmap(asked, "h")

    def picked(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(in_pairs.has(batch.column(0).to_numpy())))

    # a set's one row has its key and its h; the bitmap lets few others through, and the joins none
    found = materialize(map_batches(bodies.select("h", "key", "n", column), picked, f"h long, key binary, n long, {column} binary"), "picked")
    known = pairs.join(asked.toDF("a", "ha"), "a").join(asked.toDF("b", "hb"), "b")
    met = known.join(found.toDF("ha", "a", "n", "x"), ["a", "ha"]).join(found.toDF("hb", "b", "m", "y"), ["b", "hb"]).select("a", "b", "n", "m", "x", "y")
    out = materialize(map_batches(met, test, schema, rows=200), name)
    discard(pairs, asked, found)
    return out


def measured(bodies: DataFrame, sets: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """(a, b, both, all): sizes of intersection and union of those pairs (a, b) of keys that have a similarity of share percent or more."""

    def possible(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        allowed = (100 + share) * differ <= (100 - share) * (batch.column(2).to_numpy() + batch.column(3).to_numpy())
        return batch.select([0, 1]).filter(pa.array(allowed))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        both, union = [], []
        for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            z.sort(kind="stable")
            both.append(int((z[1:] == z[:-1]).sum()))
            union.append(len(z) - both[-1])
        b, u = np.array(both, np.int64), np.array(union, np.int64)
        out = record_batch({"a": (batch.column(0), pa.binary()), "b": (batch.column(1), pa.binary()), "both": (b, pa.int64()), "all": (u, pa.int64())})
        return out.filter(pa.array(100 * b >= share * u))

    near = _compared(bodies, sets, materialize(pairs.distinct(), "pairs"), "wide", possible, "a binary, b binary", "possible")
    return _compared(bodies, sets, near, "body", exact, "a binary, b binary, both long, all long", "distances")


def _rooted(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rows, one for each key, with the root of each set among the links found so far, as a written table."""
    roots = components(links)
    known = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = materialize(known, name)
    discard(roots)
    return known


def _possible(pairs: DataFrame, marks: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (a, b) of keys, each once, that their sizes and parity bits allow."""
    met = pairs.distinct().join(marks.withColumnRenamed("key", "a").alias("x"), "a").join(marks.withColumnRenamed("key", "b").alias("y"), "b")
    return met.filter(_allowed("x", "y", share)).select("a", "b")


def _in_slots(large: DataFrame, marks: DataFrame, slot: int, share: int) -> DataFrame:
    """All allowed pairs of different roots of each cell, a slot of sets at a time."""
    parts = large.join(marks, "key").withColumn("parts", F.ceil(F.col("m") / slot)).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    dealt = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    one = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root"))
    return _pairs(parts.alias("x").join(dealt.alias("y"), one & (F.col("x.key") < F.col("y.key")) & _allowed("x", "y", share)))


def _pivots(large: DataFrame, turn: int) -> DataFrame:
    """(shingle, p): the pivots of each cell."""
    picks = [F.max_by("key", F.struct("central", F.xxhash64("key", F.lit(turn))))]
    picks += [F.min_by("key", F.xxhash64("key", F.lit(turn), F.lit(i))) for i in range(1, PIVOTS)]
    return large.groupBy("shingle").agg(F.array(*picks).alias("all")).select("shingle", F.explode(F.array_distinct("all")).alias("p"))


def _windows(distances: DataFrame, marks: DataFrame, share: int, slot: int) -> DataFrame:
    """The pairs that regions join: a set at home in a pivot's region with a set that the window adds.

    distances: (x, p, d) up to twice the linking distance e. marks: (key, root, n, parity bits)."""
    e = 1 - share / 100
    near = distances.join(marks.withColumnRenamed("key", "x"), "x").withColumnRenamed("x", "key")
    home, rim = near.filter(F.col("d") <= e + 1e-9), near.filter(F.col("d") > e - 1e-9)
    sizes = home.groupBy("p").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / slot)).select("p", "parts")
    home = home.join(sizes, "p").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    rim = rim.join(sizes, "p").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    same = (F.col("x.p") == F.col("y.p")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root"))
    window = F.col("y.d") - F.col("x.d") <= e + 1e-9
    return _pairs(home.alias("x").join(rim.alias("y"), same & window & _allowed("x", "y", share)))


def region_links(bodies: DataFrame, sets: DataFrame, share: int = SHARE, rounds: int = ROUNDS, bucket: int = BUCKET, slot: int = SLOT) -> DataFrame:
    """(a, b): enough links between the keys of sets to connect all linked ones, and none between others.

    bodies: (h, key, n, wide, body) of all rows. sets: (key, h, n, parity bits), one row for each different set."""
    twice = 2 * share - 100  # a distance of 2e as a similarity
    links, pending, known, marks = None, None, None, sets.select("key", "n", *BITS)
    cells = _cells(bodies.select("h", "key", "body"), sets, share)
    for turn in range(rounds + 1):
        # a cell is few bytes for each of its sets; sizes and parity bits join the pairs
        rooted = cells.withColumn("root", F.col("key")) if known is None else cells.join(known.select("key", "root"), "key")
        sizes = rooted.groupBy("shingle").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle", "m")
        sized = materialize(rooted.join(sizes, "shingle"), "regions")
        discard(cells, *([] if known is None else [known]))
        small, large = sized.filter(F.col("m") <= bucket), sized.filter(F.col("m") > bucket)
        one = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.key") < F.col("y.key"))
        pairs = _pairs(small.alias("x").join(small.alias("y"), one))
        if turn == rounds:
            pairs = _possible(pairs, marks, share).union(_in_slots(large, marks, slot, share))
        else:
            pivots = materialize(_pivots(large, turn), "pivots")
            star = large.join(pivots, "shingle").filter("key != p").select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b"))
            pairs = _possible(pairs, marks, share).union(_possible(star, marks, twice))
        found = measured(bodies, sets, pairs if pending is None else pairs.union(pending), twice)
        linked = found.filter(100 * F.col("both") >= share * F.col("all")).select("a", "b")
        links = linked if links is None else links.union(linked)
        if turn == rounds or large.isEmpty():
            return links
        d = 1 - F.col("both") / F.col("all")
        both_ways = found.select(F.col("a").alias("x"), F.col("b").alias("p"), d.alias("d")).union(found.select("b", "a", d))
        of_pivots = materialize(both_ways.join(pivots.select("p").distinct(), "p", "left_semi"), "pivot-distances")
        known = _rooted(marks, links, "known")
        pending = materialize(_windows(of_pivots, known, share, slot).distinct(), "windows")
        near = of_pivots.filter(F.col("d") <= 1 - share / 100 + 1e-9).select(F.col("x").alias("key"), "p")
        at_home = near.join(large.join(pivots, "shingle"), ["key", "p"]).select("shingle", "key").union(pivots)
        cells = materialize(large.select("shingle", "key", "central").join(at_home.distinct(), ["shingle", "key"], "left_anti"), "homeless")
        discard(sized, of_pivots, pivots)
    return links


def jaccard_join(docs: DataFrame, width: int = WIDTH, share: int = SHARE, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, bucket: int = BUCKET, slot: int = SLOT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    marked = materialize(_sets(docs, doc_id, text, width), "shingle-sets")
    grouped = marked.filter("n > 0").groupBy("key", "n", *BITS).agg(F.min("h").alias("h"), F.min("doc_id").alias("least"))
    sets = materialize(grouped, "sets")
    links = region_links(marked.select("h", "key", "n", "wide", "body"), sets, share, rounds, bucket, slot)
    of = _rooted(sets.select("key", "least"), links, "rooted-sets")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(named, "root").select("key", "component_id")
    found = marked.select("doc_id", "key", F.col("n").alias("n_shingles")).join(classes, "key", "left")
    out = materialize(found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-join")
    discard(marked, sets, of)
    return out
