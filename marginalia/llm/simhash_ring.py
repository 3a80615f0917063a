"""Near-duplicate groups by SimHash, with pigeonring filtering of the candidates.

Fingerprints link if they differ in at most ``budget`` of 64 bits. They are cut into m segments that stand in a ring. By the
pigeonring principle two linked fingerprints have a segment from which every chain of l consecutive segments differs in at
most l * budget / m bits, rounded down. Fingerprints meet by what the chain leaves equal at its start, and a pair goes on to
the Hamming check only if all its longer chains keep within their budgets too. There are two rings:

* the coarse ring has budget + 1 segments; the first one is equal. With a budget of 2 that is a key of 21 bits;
* the fine ring has 3 * budget + 1 segments; the first three are equal, and the next three differ in one bit at most, so that the
  first or the second half of those is equal too: 41 bits with a budget of 2, which 10^10 random fingerprints hardly ever share.

Fingerprints of coarse buckets with more than ``bucket`` members go to the fine ring, all others are joined there. What is still
in a larger bucket of the fine ring is a family of near copies, whose pairs would grow with the square of its size. With a budget of 2
each of its members goes to the key of itself and of every fingerprint that differs from it in one bit outside the bucket's
bits. Two fingerprints at distance 2 or less share such a key, and all that share a key are within distance 2, so
linking each key's members to its least member loses and adds nothing; a key has at most 65 members. Other budgets join these buckets too.

Copies count once: everything works on distinct fingerprints, and the group of a document is found by its fingerprint.
Groups come from alternating large-star and small-star steps over tables in the shared folder.

Defined cases: a null or empty text has fingerprint 0, which links like any other; a long text is one row like any other, hashed
whole. Rows with equal ids all get a result. A null id is kept; its row takes its group's least id, which is null only if all ids
of the group are. Ties: of rows with one id, the one with the least hash of id and text stays in keep_one. Only the id and
text columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_name, discard, map_batches, materialize, record_batch, row_key


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, lower-cased in A-Z only; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.array([digest(r, 42) for r in runs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
        return record_batch({"doc_id": (batch.column(0).cast(pa.int64()), pa.int64()), "fp": (fps.view(np.int64), pa.int64())})

    return map_batches(docs.select(doc_id, text), run, "doc_id long, fp long")


def segments(n: int) -> list[int]:
    """Masks of n segments of 64 bits."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << b - a) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _chain(ring: list[int], start: int, length: int) -> int:
    return reduce(int.__or__, (ring[(start + k) % len(ring)] for k in range(length)), 0)


def _halves(mask: int) -> tuple[int, int]:
    bits = [k for k in range(64) if mask >> k & 1]
    low = sum(1 << k for k in bits[: len(bits) // 2])
    return low, mask ^ low


def ring_keys(budget: int, fine: bool) -> list[tuple[int, int]]:
    """(start, mask): two linked fingerprints agree on one of these masks, at a start from which all their chains keep within
    their budgets."""
    if not fine:
        return list(enumerate(segments(budget + 1)))
    ring = segments(3 * budget + 1)
    return [(i, _chain(ring, i, 3) | half) for i in range(len(ring)) for half in _halves(_chain(ring, i + 3, min(3, len(ring) - 3)))]


def _within_chains(a: Column, b: Column, key: Column, keys: list[tuple[int, int]], ring: list[int], budget: int) -> Column:
    """Every chain from the key's start, the whole ring included, keeps within its budget. Chains are masks, looked up by key."""
    n = len(ring)
    tests = []
    for length in range(1, n + 1):
        masks = F.array(*(F.lit(_signed(_chain(ring, start, length))).cast("long") for start, _ in keys))
        tests.append(F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.get(masks, key))) <= length * budget // n)
    return reduce(Column.__and__, tests)


def _one_ring(fps: DataFrame, budget: int, fine: bool, bucket: int | None) -> tuple[DataFrame, DataFrame]:
    """(links, large): the links found in buckets of at most ``bucket`` fingerprints, and the rows (fp, k, seg) of all larger ones."""
    keys = ring_keys(budget, fine)
    ring = segments(3 * budget + 1 if fine else budget + 1)
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("seg")) for k, (_, m) in enumerate(keys)))
    rows = fps.select("fp", F.inline(each))
    sizes = rows.groupBy("k", "seg").agg(F.count("*").alias("n")).filter("n > 1")
    sized = materialize(rows.join(sizes, ["k", "seg"]), "ring")
    small = sized if bucket is None else sized.filter(F.col("n") <= bucket)
    x, y = small.alias("x"), small.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    same = (F.col("x.k") == F.col("y.k")) & (F.col("x.seg") == F.col("y.seg"))
    links = x.join(y, same & (a < b) & _within_chains(a, b, F.col("x.k"), keys, ring, budget)).select(a.alias("a"), b.alias("b"))
    return links, sized.filter(F.lit(bucket is not None) & (F.col("n") > (bucket or 0)))


def _stars(large: DataFrame, masks: list[int]) -> DataFrame:
    """Links of the fingerprints of large buckets (fp, k, seg), for a budget of 2, without pairs."""
    free = F.get(F.array(*(F.lit(_signed(~m & (1 << 64) - 1)).cast("long") for m in masks)), F.col("k"))
    flips = F.array(
        F.col("fp"),
        *(F.when(F.shiftrightunsigned("free", k).bitwiseAND(F.lit(1)) == 1, F.col("fp").bitwiseXOR(F.lit(_signed(1 << k)))) for k in range(64)),
    )
    keys = large.withColumn("free", free).select("fp", F.explode(F.array_compact(flips)).alias("key")).distinct()
    together = keys.groupBy("key").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return together.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")


def ring_links(fps: DataFrame, budget: int = 2, bucket: int = 64) -> DataFrame:
    """(a, b), a < b: enough links between the distinct values of column fp to connect every linked pair, and no
    link between values that differ in more than budget bits."""
    coarse, large = _one_ring(fps.select("fp"), budget, False, bucket)
    if large.isEmpty():
        return coarse.distinct()
    fine, family = _one_ring(large.select("fp").distinct(), budget, True, bucket if budget == 2 else None)
    links = coarse.union(fine)
    if not family.isEmpty():
        links = links.union(_stars(family, [m for _, m in ring_keys(budget, True)]))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node each node of links (a, b) reaches, by alternating star contraction until nothing changes.

    Every step is one grouping by node. A node's neighbours aren't gathered: the least neighbour is joined back to the
    links, so that a node with very many links can be split. The tables of a step go when the next one is written."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every neighbour above a node links to the least of the node and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        discard(edges)
        # small star: a node and its neighbours below link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct(),
            "edges",
        )
        discard(large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots.stored_at = edges.stored_at
    return roots


def groups(marked: DataFrame, budget: int = 2, links: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id, n_fps) of every different fingerprint of marked (doc_id, fp): the least fingerprint and the least id
    that links reach, and the number of different fingerprints of the group. Other links (a, b) can stand for those of the
    fingerprints."""
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(ring_links(classes.select("fp"), budget) if links is None else links)
    known = materialize(
        classes.join(roots, classes["fp"] == roots["node"], "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    ids = materialize(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fps")), "ids")
    found = materialize(known.join(ids, "root").select("fp", "root", "component_id", "n_fps"), "by-fp")
    discard(classes, roots, known, ids)
    return found


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, n_fps), one row for each row of docs."""
    marked = materialize(fingerprints(docs, width, doc_id, text), "fingerprints")
    return marked.join(groups(marked, budget), "fp").select("doc_id", "fp", "component_id", "n_fps")


def keep_one(docs: DataFrame, width: int = 5, budget: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the least id of their group, one of them if several have that id. A group whose ids are all
    null keeps one row."""
    row = clean_name(docs, "_row")
    numbered = docs.withColumn(row, row_key(doc_id, text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(2).to_pylist()], np.uint64)
        return record_batch({"doc_id": (batch.column(0).cast(pa.int64()), pa.int64()), "row": (batch.column(1), pa.binary()), "fp": (fps.view(np.int64), pa.int64())})

    marked = materialize(map_batches(numbered.select(doc_id, row, text), run, "doc_id long, row binary, fp long"), "fingerprints")
    return keep_first(docs, numbered, marked, groups(marked.select("doc_id", "fp"), budget), row)


def keep_first(docs: DataFrame, numbered: DataFrame, marked: DataFrame, found: DataFrame, row: str) -> DataFrame:
    """keep_one's rows of docs, by the groups found of marked (doc_id, row, fp). numbered: docs with the column row.

    Both tables are read no more afterwards."""
    kept = clean_name(docs, "_kept")
    # of each group the row with the least id, then the least key of id and text: parts of one group are summed up in the tasks
    first = (
        marked.join(found, "fp")
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("row").alias(kept))
        .select(kept)
    )
    first = materialize(first, "kept")
    discard(marked, found)
    # rows that are equal in id and text have one key; the first of each stays
    return numbered.join(first, F.col(row) == F.col(kept), "left_semi").dropDuplicates([row]).select(*docs.columns)
