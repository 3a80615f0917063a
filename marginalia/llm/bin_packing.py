"""Best-fit packing into bins of several permitted lengths.

Texts longer than the longest permitted length are cut into pieces of that length and a rest; nothing is dropped. Pieces
are taken longest first. A piece goes to the open bin, of whatever size, that it leaves with the least room (the oldest
of equals). If it fits none, a bin is opened with the permitted size of least cost per token it can hope to hold: its
cost over the smaller of its size and of what is still to be packed. In the end every bin shrinks to the smallest
permitted length that holds its contents.

Lengths are token counts of the byte-level BPE (bpe_matrix), or any column. ``pack_bins`` can keep the token ids, so that a bin is a
training sequence. Each task packs the rows of its own input partition, in rounds of bounded size, so there is no shuffle of texts and no
key that could be hot. In its last round a task keeps back the bins that are filled by less than ``REST``: their pieces, a few bins of each
partition, are packed again together. A bin's number is its partition's number followed by its number there.

Defined cases: a null or empty text has no tokens; it has one row with piece 0, no bin and capacity 0. A very long text is cut into
pieces of the longest permitted length, in order. Rows with equal ids are packed each for itself; ties go to the row that comes first.
Only the id and text columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_matrix import coder
from .common import bound_batches, materialize, record_batch, slices

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def bin_cost(capacity: int, overhead: float = 64.0, quadratic: float = 1 / 16384) -> float:
    """A bin costs its length, a fixed overhead, and a share that grows with the square of its length."""
    return overhead + capacity + quadratic * capacity * capacity


def pieces(lengths: Sequence[int], longest: int) -> list[tuple[int, int, int, int]]:
    """(item, piece, start, length) of all pieces."""
    out = []
    for item, n in enumerate(lengths):
        out += [(item, k, at, min(longest, n - at)) for k, at in enumerate(range(0, n, longest))]
    return out


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, int, int, int, int, int, int]]:
    """(item, piece, start, length, bin, capacity, place in the bin) of all pieces of items with a length."""
    capacities = sorted(capacities)
    todo = sorted(pieces(lengths, capacities[-1]), key=lambda p: (-p[3], p[0], p[1]))
    left = sum(p[3] for p in todo)
    cost = {c: bin_cost(c) for c in capacities}
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin) of the open bins, in order
    placed = []
    for item, piece, start, n in todo:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (cost[c] / min(c, left), c))
            free, b = size, len(used)
            used.append(0)
        placed.append((item, piece, start, n, b, used[b]))
        used[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return [(item, piece, start, n, b, final[b], place) for item, piece, start, n, b, place in placed]


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


REST = 0.9
REST_BINS = 4096  # kept back bins that are packed together
BINS = "bin_id long, capacity int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>, places array<int>, ids array<int>"
_KINDS = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
_NAMES = [c.split(" ")[0] for c in BINS.split(", ")]
Item = tuple[int | None, int, int, int, np.ndarray]  # document, piece, start, length, ids (empty if they aren't kept)


def _rows(items: list[Item], capacities: Sequence[int], base: int, hold: bool) -> tuple[list[tuple], int]:
    """Rows of BINS for items, and how many bins there are. With hold, bins filled by less than REST have neither number nor capacity."""
    rows: list[tuple] = [(None, 0, [d], [0], [0], [0], [0], []) for d, _, _, n, _ in items if not n]
    bins: dict[int, list[tuple]] = {}
    for i, k, s, n, b, c, at in pack([item[3] for item in items], capacities):
        bins.setdefault(b, []).append((at, i, k, s, n, c))
    for b, parts in sorted(bins.items()):
        parts.sort()
        capacity, used = parts[0][5], parts[-1][0] + parts[-1][4]
        kept = hold and used < REST * capacity
        own = [items[p[1]] for p in parts]
        ids = np.concatenate([x[4][p[3] : p[3] + p[4]] for x, p in zip(own, parts, strict=True)])
        rows.append(
            (
                None if kept else base + b,
                None if kept else capacity,
                [x[0] for x in own],
                [x[1] + p[2] for x, p in zip(own, parts, strict=True)],
                [x[2] + p[3] for x, p in zip(own, parts, strict=True)],
                [p[4] for p in parts],
                [p[0] for p in parts],
                ids,
            )
        )
    return rows, len(bins)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return record_batch({name: (list(x), kind) for name, x, kind in zip(_NAMES, columns, _KINDS, strict=True)})


def pack_bins(
    docs: DataFrame,
    tokens: tuple[str, str] | None = None,
    length: Column | None = None,
    keep_ids: bool = False,
    capacities: Sequence[int] = CAPACITIES,
    per_round: int = 2_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per bin: bin_id, capacity, and in order the doc_ids, piece numbers, starts, lengths and places of its pieces, and the
    ids of them all. Rows without a bin are documents without tokens.

    tokens: (file of ranks, split pattern) of the tokenizer that measures and encodes the texts; without it ``length`` does, by
    default words. per_round: tokens or rows that are packed at once."""
    get = coder(docs, *tokens) if tokens else None
    measured = F.col(text) if tokens else (word_count(text) if length is None else length)

    def items_of(batch: pa.RecordBatch) -> Iterator[Item]:
        none = np.empty(0, np.int32)
        if get is None:
            yield from ((d, 0, 0, n, none) for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            return
        codec, split = get()
        encoded = codec.encode_texts(split.findall(t or "") for t in batch.column(1).to_pylist())
        for d, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            yield d, 0, 0, len(ids), ids if keep_ids else none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        items: list[Item] = []
        volume = opened = 0
        for batch in batches:
            for part in slices(batch, 2000):
                for item in items_of(part):
                    items.append(item)
                    volume += item[3]
                if volume >= per_round or len(items) >= per_round:
                    rows, n = _rows(items, capacities, base + opened, False)
                    yield _batch(rows)
                    items, volume, opened = [], 0, opened + n
        yield _batch(_rows(items, capacities, base + opened, True)[0])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + (TaskContext.get().partitionId() << 32)
        items: list[Item] = []
        for batch in batches:
            for _, _, documents, pieces, starts, lengths, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for d, k, s, n in zip(documents, pieces, starts, lengths, strict=True):
                    items.append((d, k, s, n, np.array(ids[at : at + n], np.int32)))
                    at += n
        yield _batch(_rows(items, capacities, base, False)[0])

    bound_batches(docs.sparkSession)
    first = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), measured.alias("n")).mapInArrow(run, BINS), "bins")
    kept = first.filter("capacity IS NULL")
    parts = max(1, -(-kept.count() // REST_BINS))
    # the same rows come in the same order to a task that is repeated
    merged = kept.repartition(parts, "doc_ids", "pieces").sortWithinPartitions("doc_ids", "pieces").mapInArrow(again, BINS)
    return first.filter("capacity IS NOT NULL").unionByName(merged)


def pack_documents(docs: DataFrame, length: Column | None = None, **settings) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, capacity, place): one row per piece of a document. See pack_bins for the settings."""
    packed = pack_bins(docs, length=length, **settings)
    each = F.inline(F.arrays_zip("doc_ids", "pieces", "starts", "lengths", "places")).alias("doc_id", "piece", "start", "length", "place")
    return packed.select("bin_id", "capacity", each).select("doc_id", "piece", "start", "length", "bin_id", "capacity", "place")


def fill(packed: DataFrame) -> DataFrame:
    """(capacity, bins, tokens, fill) of pack_bins' rows: the share of each size's room that tokens take."""
    used = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = packed.filter("bin_id IS NOT NULL").groupBy("capacity").agg(F.count("*").alias("bins"), F.sum(used).alias("tokens"))
    return sums.withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))
