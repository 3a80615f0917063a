"""Byte-level BPE with numpy matrices instead of a loop per piece.

The distinct pieces of a batch of texts are put into matrices, one row a piece, padded, and bucketed by length.
In each round every row merges its leftmost pair of least rank: the ranks of all neighbouring pairs come from one
open-addressing hash table, the winners are replaced, and the rows are compacted by one position. A row without
a pair that merges is done and leaves the matrix. Pieces longer than ``matrix_bytes`` (runs without a word break)
would need as many rounds as they have bytes, each over the whole row; they are merged with a heap, by the same rule, one at a time.

The vocabulary is a file of ranks whose place is a parameter. It is read on the driver and sent as a broadcast of
fixed size, so executors need no copy of the file.

Defined cases: a null text is encoded as the empty text, which has no ids. Every input row gives one output row, repeated rows
too; only the id and text columns are read. Texts are encoded whole, however long; ties go to the leftmost pair. An empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record_batch

NONE = np.int32(2**31 - 1)
KNOWN, KNOWN_BYTES = 200_000, 4 << 20  # pieces that a worker keeps from batch to batch; beyond either it begins anew
PIECES = 250_000  # pieces that are held as objects at once, besides the different ones of a batch and those of one text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing over a power-of-two table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, ranks_left = np.array(keys, np.int64), np.array(values, np.int32)
        slot, self.probes = self.slot(left), 0
        while len(left):  # place all that find a free slot; the rest move on by one
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]
            placed = self.keys[slot] == left
            self.values[slot[placed]] = ranks_left[placed]
            left, ranks_left = left[~placed], ranks_left[~placed]
            slot = slot[~placed] + 1 & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self.slot(keys)
        there = self.keys.take(slot)
        hit = there == keys
        out = np.where(hit, self.values.take(slot), NONE)
        open_ = np.flatnonzero(~hit & (there != -1))
        flat, at = keys.ravel(), slot.ravel()[open_]
        result = out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            at = at + 1 & (1 << self.bits) - 1
            seen = self.keys[at]
            hit = seen == flat[open_]
            result[open_[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            open_, at = open_[go], at[go]
        return result.reshape(keys.shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], matrix_bytes: int = 128, matrix_cells: int = 400_000):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        used = self.pairs.keys != -1
        self.pair_rank = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.matrix_bytes, self.matrix_cells = matrix_bytes, matrix_cells
        self.forget()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, size): the ids of piece k are pool[begin[k] : begin[k] + size[k]]."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        pools: list[np.ndarray] = []
        filled = 0
        buckets: dict[int, tuple[list[int], list[bytes]]] = {}
        known, known_ids = [], []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                known.append(k)
                known_ids.append(rank)
            elif len(piece) > self.matrix_bytes:
                ids = self.by_heap(piece)
                begin[k], size[k] = filled, len(ids)
                pools.append(ids)
                filled += len(ids)
            elif piece:
                members, own = buckets.setdefault((len(piece) + 3) // 4 * 4, ([], []))
                members.append(k)
                own.append(piece)
        begin[known], size[known] = filled + np.arange(len(known)), 1
        pools.append(np.array(known_ids, np.int32))
        filled += len(known)
        for width, (members, own) in buckets.items():
            step = max(1, self.matrix_cells // width)
            for at in range(0, len(members), step):
                ids, n = self.by_matrix(own[at : at + step], width)
                part = members[at : at + step]
                begin[part], size[part] = filled + np.cumsum(n) - n, n
                pools.append(ids)
                filled += len(ids)
        return np.concatenate(pools), begin, size

    def by_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_id[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = np.where(ids[:, 1:] >= 0, self.pairs.find(ids[:, :-1], ids[:, 1:]), NONE)
        done = np.empty_like(ids)
        rows = np.arange(len(pieces))
        columns = np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of the least
            line = np.arange(len(rows))
            best = rank[line, at]
            stop = best == NONE
            if stop.any():
                done[rows[stop], : ids.shape[1]] = ids[stop]
                go = ~stop
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = best
            # compaction: everything right of the merged pair moves one place to the left, and every row is one shorter
            keep = columns[None, : ids.shape[1] - 1]
            source = keep + (keep > at[:, None]) + (line * ids.shape[1])[:, None]
            ids, rank = ids.ravel().take(source), rank.ravel().take(source)
            rank[:, -1] = NONE
            length[rows] -= 1
            for where, ok in ((at, at + 1 < ids.shape[1]), (at - 1, at > 0)):
                i = np.flatnonzero(ok)
                a, b = ids[i, where[i]], ids[i, where[i] + 1]
                rank[i, where[i]] = np.where(b >= 0, self.pairs.find(a, b), NONE)
        return done[columns < length[:, None]], length

    def by_heap(self, piece: bytes) -> np.ndarray:
        """Leftmost least pair first, in n log n, for one long piece."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pair_rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_texts(self, split: Iterable[list[str]]) -> list[np.ndarray]:
        """Ids of each text, given as its pieces. Each distinct piece is merged once, and not again in the batches that follow while it is
        known; of the others only the number is kept, since as objects pieces take some twenty times their bytes."""
        index, known = self.index, len(self.index)
        codes: list[np.ndarray] = []
        counts: list[int] = []
        held: list[str] = []

        def number() -> None:
            coded = pa.array(held, pa.string()).dictionary_encode()
            own = [index.setdefault(p, len(index)) for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
            codes.append(np.array(own, np.int32)[coded.indices.to_numpy()])
            held.clear()

        for pieces in split:
            held += pieces
            counts.append(len(pieces))
            if len(held) >= PIECES:
                number()
        number()
        code = np.concatenate(codes)
        del codes
        fresh = [p.encode() for p in islice(index, known, None)]
        found = (self.pool, self.begin, self.sizes), self.encode_pieces(fresh)
        pool, begin, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        begin[known:] += len(self.pool)
        out, at = [], 0
        for count in counts:
            own = code[at : at + count]
            at += count
            n = sizes[own]
            total = int(n.sum())
            shift = np.repeat(begin[own] - (np.cumsum(n) - n), n)
            out.append(pool[shift + np.arange(total)])
        self.known_bytes += sum(map(len, fresh))
        if len(index) > KNOWN or self.known_bytes > KNOWN_BYTES:
            self.forget()
        else:
            self.pool, self.begin, self.sizes = pool, begin, sizes
        return out

    def forget(self) -> None:
        """Begin anew with no piece known."""
        self.index: dict[str, int] = {}
        self.pool, self.begin, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.known_bytes = 0

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.token_size[ids]
        shift = np.repeat(self.token_begin[ids] - (np.cumsum(n) - n), n)
        return self.token_bytes[shift + np.arange(len(shift))].tobytes()


class Splitter:
    """findall of a split pattern. Texts within Latin-1 go through the standard library's engine, which is faster
    with the classes \\p{L}, \\p{N} and \\s spelt out for these 256 characters; all others through regex."""

    def __init__(self, pattern: str):
        import regex

        def spelt(kind: str) -> str:
            return "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))

        self.wide = regex.compile(pattern).findall
        self.narrow = re.compile(
            re.sub(
                r"\\S|\[(?:[^\]\\]|\\p\{.\}|\\.)*\]|\\s|\\p\{[LN]\}",
                lambda m: (
                    f"[^{spelt(chr(92) + 's')}]"
                    if m[0] == "\\S"
                    else re.sub(r"\\s|\\p\{[LN]\}", lambda k: spelt(k[0]), m[0] if m[0][0] == "[" else f"[{m[0]}]")
                ),
                pattern,
            )
        ).findall

    def findall(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)


SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


_made: dict[str, tuple[Codec, Splitter]] = {}  # in each worker, for as long as it lives


def coder(docs: DataFrame, ranks_path: str, pattern: str):
    """A function that gives each worker its codec and its split pattern, made once."""
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    name = uuid.uuid4().hex

    def get() -> tuple[Codec, Splitter]:
        if name not in _made:
            _made.clear()
            _made[name] = Codec(sent.value), Splitter(pattern)
        return _made[name]

    return get


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Ids of every text and the bytes they decode to; with digest, their count and hashes instead."""
    get = coder(docs, ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, split = get()
        ids = codec.encode_texts(split.findall(t or "") for t in batch.column(1).to_pylist())
        decoded = [codec.decode(x) for x in ids]
        own = {"doc_id": (batch.column(0).cast(pa.int64()), pa.int64())}
        if not digest:
            return record_batch(own | {"ids": (ids, pa.list_(pa.int32())), "decoded": (decoded, pa.binary())})
        return record_batch(
            own
            | {
                "n_tokens": ([len(x) for x in ids], pa.int64()),
                "ids_sha256": ([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": ([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
        )

    return map_batches(docs.select(doc_id, text), run, DIGEST if digest else SCHEMA, rows=2000)
