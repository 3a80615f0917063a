"""Near duplicates of the corpus pipeline: SimHash groups, checked and completed by the Jaccard similarity of word shingles.

Texts link at a similarity of 4/5 or more of their sets of five-word shingles. Equal sets count once. Three steps, each of which
leaves less to the next:

1. The ring of simhash_ring groups the sets whose fingerprints (of the same shingles) differ in ``budget`` bits or fewer; each is
   compared, as a whole set, with a few leaders of its group. That links most of a family of near copies along few links.
2. Sets at 4/5 differ in some ten bits of 64, where no key of a fingerprint is selective, so the rest is found by shingles: in one
   order of all shingles, two sets at 4/5 or more share one of the first ``n - ceil(4n/5) + 1`` shingles of both. The order puts
   shingles last that a sample of texts finds often, so common lines are rarely among the first; the sample changes the work,
   never the result. Only pairs of different groups are candidates; they must keep within 4/5 by size, and the 256 parity
   bits of their sets may differ in no more bits than the sets may in shingles; then 4096 such bits. What stays is compared as whole sets.
3. Shingles that more than ``bucket`` sets have among their first are not joined with themselves. Their sets are compared with a few
   leaders first: the most central one (the one with most of its first shingles in other sets too) and some by hash. What that links needs
   no more comparing; the sets outside a shingle's largest group meet all sets of other groups there, in slots of ``slot`` sets, and two
   sets at the least shingle they share. So a family of near copies costs its size times the leaders, and no pair is lost.

Defined cases: texts without words (null and empty ones too) are equal. A text of fewer words than the width has one shingle; a long
text is taken whole. Sets are known by 128 bits, shingles by 64, which can only make two texts that differ in one shingle look
equal there. Ids, ties, repeated rows and clashing names are as in simhash_ring.keep_one. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_name, discard, map_batches, materialize, record_batch, row_key
from .simhash_ring import components, fingerprint, groups, keep_first, ring_links
from .suffix_dedup import ODD, Bitmap, mix

BITS = ("s0", "s1", "s2", "s3")
SAMPLE, OFTEN, LEADERS, SEEN = 8, 4, 3, 16


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``width`` words, lower-cased in A-Z only; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = len(codes) - width + 1
    if runs < 1:
        width, runs = len(codes), min(1, len(codes))
    out = codes[:runs].copy()
    for k in range(1, width):
        out = out * np.uint64(ODD) + codes[k : k + runs]
    return np.unique(mix(out))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def first_shingles(shingles: np.ndarray, often: Bitmap) -> np.ndarray:
    n = len(shingles)
    late = np.concatenate([shingles[~(o := often.has(shingles))], shingles[o]]) if n else shingles
    return late[: n - (4 * n + 4) // 5 + 1] if n else late


def parity(shingles: np.ndarray, size: int = 256) -> np.ndarray:
    """size bits, each the parity of the number of shingles that belong to it."""
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _within(x: str, y: str) -> Column:
    """Never false for a pair at 4/5 or more."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in BITS), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differ <= n + m)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))


def picked(batch: pa.RecordBatch, wanted: Bitmap, width: int) -> dict[bytes, np.ndarray]:
    """The sets of the wanted texts of a batch (h, text), by their keys."""
    hit = pa.array(wanted.has(batch.column(0).to_numpy()))
    sets = (shingle_set(t, width) for t in batch.column(1).filter(hit).to_pylist())
    return {set_key(s): s for s in sets}


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)


def jaccard_links(texts: DataFrame, sets: DataFrame, width: int = 5, budget: int = 2, bucket: int = 4, slot: int = 256) -> DataFrame:
    """(a, b): enough links between the ids of sets to connect all linked sets, and none between others.

    texts: (h, text). sets: (key, id, fp, h), one row for each different set with the h of one text that has it."""
    wanted = Bitmap(sets, "h")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """The links, by id, of the pairs (a, b) of set keys that are at 4/5 or more."""
        kept = compared(texts, sets, materialize(pairs.distinct(), "candidates"), width)
        a, b = sets.select(F.col("key").alias("a"), F.col("id").alias("ia")), sets.select(F.col("key").alias("b"), F.col("id").alias("ib"))
        found = materialize(kept.join(a, "a").join(b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")), name)
        discard(kept)
        return found

    def rooted(links: DataFrame) -> DataFrame:
        """(key, root) of every set."""
        roots = components(links)
        known = materialize(sets.join(roots, sets["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("root")), "rooted")
        discard(roots)
        return known

    ring = compare(ring_pairs(sets, budget), "ring-links")
    known = rooted(ring)

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(picked(batch, wanted, width).values())
        shingles, n = np.unique(_flat(found), return_counts=True)
        return record_batch({"shingle": (shingles, pa.int64()), "n": (n, pa.int64())})

    sample = texts.filter(F.pmod(F.xxhash64("h"), F.lit(SAMPLE)) == 0)
    counted = map_batches(sample, sampled, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = materialize(counted.filter(F.col("n") >= OFTEN).select("shingle"), "often")
    often = Bitmap(common, "shingle")

    def first(batch: pa.RecordBatch) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
        """Keys, sets and first shingles of the different sets of a batch."""
        by_key = picked(batch, wanted, width)
        own = list(by_key.values())
        return list(by_key), own, [first_shingles(s, often) for s in own]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, _, firsts = first(batch)
        short = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
        return record_batch({"shingle": (_flat(firsts), pa.int64()), "key": (np.repeat(short, [len(f) for f in firsts]), pa.int64())})

    spread = map_batches(texts, count, "shingle long, key long").groupBy("shingle").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = materialize(spread.filter("a < b").select("shingle"), "several")
    shared = Bitmap(several, "shingle")
    discard(common, several)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, own, firsts = first(batch)
        hits = [f[shared.has(f)] for f in firsts]
        times = [len(h) for h in hits]
        central = [100 * t // max(1, len(f)) for t, f in zip(times, firsts, strict=True)]
        bits = np.repeat(np.array([parity(s) for s in own], np.int64).reshape(-1, 4), times, axis=0)
        return record_batch(
            {
                "shingle": (_flat(hits), pa.int64()),
                "key": ([k for k, n in zip(keys, times, strict=True) for _ in range(n)], pa.binary()),
                "n": (np.repeat(np.array([len(s) for s in own], np.int64), times), pa.int64()),
                "central": (np.repeat(np.array(central, np.int64), times), pa.int64()),
            }
            | {s: (np.ascontiguousarray(bits[:, i]), pa.int64()) for i, s in enumerate(BITS)}
        )

    schema = "shingle long, key binary, n long, central long, " + ", ".join(f"{s} long" for s in BITS)
    rows = materialize(map_batches(texts, place, schema).distinct(), "first-shingles")
    sizes = rows.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1")
    sized = materialize(rows.join(sizes, "shingle").join(known, "key"), "shared-shingles")
    discard(rows, known)
    small, large = sized.filter(F.col("m") <= bucket), sized.filter(F.col("m") > bucket)
    x, y = F.col("x.key"), F.col("y.key")
    one = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
    pairs = _pairs(small.alias("x").join(small.alias("y"), one & (x < y) & _within("x", "y")))
    if large.isEmpty():
        return ring.union(compare(pairs, "near-links"))

    whole = F.struct("key", "root", "n", *BITS)
    # in a family of near copies the most central set is nearest to all others: sets far from each other meet there
    lead = F.array(F.max_by(whole, F.struct("central", F.xxhash64("key"))), *(F.min_by(whole, F.xxhash64("key", F.lit(i))) for i in range(1, LEADERS)))
    leaders = materialize(large.groupBy("shingle").agg(lead.alias("all")).select("shingle", F.explode(F.array_distinct("all")).alias("l")).select("shingle", "l.*"), "leaders")
    star = large.alias("x").join(leaders.alias("y"), one & _within("x", "y"))
    links = ring.union(compare(pairs.union(_pairs(star)), "near-links"))
    discard(leaders)

    # the rest of the large shingles: pairs of different groups
    known = rooted(links)
    grouped = materialize(large.drop("root").join(known, "key"), "grouped")
    members = grouped.select("root", "key").distinct().groupBy("root").agg(F.count("*").alias("size"))
    main = (
        grouped.join(members, "root")
        .groupBy("shingle")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("size", "root"))["root"].alias("main"))
        .filter("low < high")
        .select("shingle", "main")
    )
    mixed = grouped.join(main, "shingle").withColumn("parts", F.ceil(F.col("m") / slot))
    mixed = mixed.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    # two sets meet at the least shingle they share: not where both have a lesser one among their first few (which saves rows, never a pair)
    few = mixed.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("shingle")), 1, SEEN).alias("few"))
    mixed = materialize(mixed.join(few, "key").withColumn("before", F.filter("few", lambda s: s < F.col("shingle"))).drop("few"), "mixed")
    discard(sized, known, grouped)
    others = mixed.filter("root != main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    once = (F.col("y.root") == F.col("y.main")) | (x < y)
    least = ~F.arrays_overlap("x.before", "y.before")
    rest = _pairs(others.alias("x").join(mixed.alias("y"), one & (F.col("x.part") == F.col("y.part")) & once & _within("x", "y") & least))
    last = compare(rest, "rest-links")
    discard(mixed)
    return links.union(last)


def ring_pairs(sets: DataFrame, budget: int) -> DataFrame:
    """(a, b): pairs of set keys that SimHash proposes: each set of a group of near fingerprints with the group's leaders."""
    found = components(ring_links(sets.select("fp").distinct(), budget))
    of_group = materialize(sets.join(found, sets["fp"] == found["node"], "left").select("key", F.coalesce("root", "fp").alias("root")), "ring-groups")
    discard(found)
    lead = F.array(*(F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(LEADERS)))
    leaders = of_group.groupBy("root").agg(F.count("*").alias("n"), lead.alias("all")).filter("n > 1").select("root", F.explode(F.array_distinct("all")).alias("leader"))
    met = of_group.join(leaders, "root").filter(F.col("key") != F.col("leader"))
    return met.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))


def compared(texts: DataFrame, sets: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets are at 4/5 or more. The table of pairs is read no more afterwards."""

    def kept(pairs: DataFrame, of, test, name: str) -> DataFrame:
        members = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        asked = materialize(sets.join(members, "key", "left_semi").select("h"), "asked")
        in_pairs = Bitmap(asked, "h")

        def bodies(batch: pa.RecordBatch) -> pa.RecordBatch:
            by_key = picked(batch, in_pairs, width)
            own = by_key.values()
            return record_batch({"key": (list(by_key), pa.binary()), "n": ([len(s) for s in own], pa.int64()), "body": ([of(s).tobytes() for s in own], pa.binary())})

        def check(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, m, p, q = (c.to_pylist() for c in batch.columns[2:])
            got = [test(k, l, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for k, l, x, y in zip(n, m, p, q, strict=True)]
            return batch.select([0, 1]).filter(pa.array(got, pa.bool_()))

        # other texts with the same h, and the bitmap's false hits, are few; each set counts once
        found = materialize(map_batches(texts, bodies, "key binary, n long, body binary").dropDuplicates(["key"]), "bodies")
        x, y = found.toDF("a", "n", "x"), found.toDF("b", "m", "y")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y")
        near = materialize(map_batches(both, check, "a binary, b binary", rows=200), name)
        discard(pairs, asked, found)
        return near

    near = kept(pairs, lambda s: parity(s, 4096), lambda n, m, x, y: 9 * int(np.bitwise_count(x ^ y).sum()) <= n + m, "near")
    return kept(near, lambda s: s, lambda n, m, x, y: similar(x, y), "links")


def keep_one(docs: DataFrame, width: int = 5, budget: int = 2, doc_id: str = "doc_id", text: str = "text", bucket: int = 4, slot: int = 256) -> DataFrame:
    """The rows of docs with the least id of their group, as simhash_ring.keep_one."""
    row = clean_name(docs, "_row")
    numbered = docs.withColumn(row, row_key(doc_id, text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
        return record_batch(
            {
                "doc_id": (batch.column(0).cast(pa.int64()), pa.int64()),
                "row": (batch.column(1), pa.binary()),
                "key": ([set_key(s) for s in own], pa.binary()),
                "fp": (np.array([fingerprint(s) for s in own], np.uint64).view(np.int64), pa.int64()),
            }
        )

    marked = materialize(map_batches(numbered.select(doc_id, row, text), run, "doc_id long, row binary, key binary, fp long"), "set-keys")
    # a set is known to the scans of the texts by the hash of one row that has it, and to the groups by a number
    one = marked.groupBy("key").agg(F.min(F.xxhash64("row")).alias("h"), F.min("fp").alias("fp"))
    sets = materialize(one.withColumn("id", F.monotonically_increasing_id()), "sets")
    texts = numbered.select(F.xxhash64(row).alias("h"), F.col(text).alias("text"))
    links = jaccard_links(texts, sets, width, budget, bucket, slot)
    by_id = materialize(marked.join(sets.select("key", F.col("id").alias("node")), "key").select("doc_id", "row", F.col("node").alias("fp")), "set-marks")
    discard(marked)
    found = groups(by_id.select("doc_id", "fp"), links=links)
    discard(sets)
    return keep_first(docs, numbered, by_id, found, row)
