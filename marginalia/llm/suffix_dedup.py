"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if it lies in a string of ``length`` bytes that starts at more than one place of all texts.

Finding where to look. Every string of ``length`` bytes has a least gram (by a hash of its ``gram`` bytes) which is a function
of the string alone; the places that are least in some string are the *anchors*. Equal strings have equal anchors at the
same distance, so a string can repeat only if its anchor's gram does. Anchors are counted over all texts. Around each anchor
that repeats lies its *context*: all bytes of the strings that have it as least gram. Equal contexts of one gram
are one item with a count. A context that occurs twice is covered whole. A gram with one context is settled by that count;
the contexts of the other grams are compared by suffix array.

Suffix array. The contexts of a bucket (those of one gram) are put one after the other and read as symbols: tokens that end with
a cut byte, ranked in the order of their bytes, so that the order of token suffixes is the order of byte suffixes. The
array is built by linear grouping: suffixes are grouped by their Lyndon prefix, the groups are processed in descending
order, each group moves the suffixes its members point to by their previous-smaller pointers behind the rest of their own
groups, by the number of pointers, and in the end each group's order is emitted along the same pointers. Nothing is renamed
and nothing recurses. Neighbours' common prefixes in bytes cut the order into classes of equal strings; a string that
starts inside a token joins the class of the next token's suffix with the bytes before it.

Units. A text is a row of units: bytes here, words (as 64-bit codes) in ``passages``, where each code is a symbol of its own.
``length`` and ``gram`` count units.

Scale. Nothing is gathered per text, gram or string except contexts of one bucket, and a bucket of more than ``bucket``
contexts is split: its parts settle what they can, and the different strings of all parts meet again by their hash, beside the hash of
their gram. Two bitmaps of repeated grams and wanted contexts go to the tasks; they have 32 bits for each entry, at most 2^29 (64 MB),
and only save rows: a false hit changes nothing, and beyond some 10^8 entries they save less. Texts are known by 128 bits of their id
and content, contexts by 64 bits besides their gram's. A passage that very many texts share is one row with a count on one side of
the join that takes its count back to its places, so that Spark can split the other side.

Defined cases: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; a very long text is taken whole, as one
row of one task. Rows with equal ids, and whole rows that repeat, are texts of their own. Every input row gives one output row; only
the id and text columns are read, whatever other columns are called. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_name, discard, map_batches, materialize, record_batch, row_key

LENGTH, GRAM = 400, 256
ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**k and its inverse for k < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of substrings: a polynomial modulo 2**64 over random values of the units, mixed afterwards."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _TABLE[data] if data.dtype == np.uint8 else mix(data)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every window of width items: each window is the end of one block and the beginning of the next."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    begin = op.accumulate(blocks, axis=1).ravel()
    end = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(end[: n - width + 1], begin[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in some string of length units; equal grams all count."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = Rolling(data).all(gram)
    width = length - gram + 1
    least = np.zeros(len(h) + width - 1, np.uint64)
    least[width - 1 : len(h)] = sliding(h, width, np.minimum, (1 << 64) - 1)
    at = np.flatnonzero(sliding(least, width, np.maximum, 0) == h)
    return at, h[at]


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Order of the suffixes of symbols, whose last is the only least one, by linear grouping."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(begin, n))
    by_suffix = np.empty(n, np.int64)
    by_suffix[order] = np.repeat(begin, sizes)
    group = by_suffix.tolist()  # where each suffix's group begins
    by_suffix[order] = np.arange(n)
    place, line = by_suffix.tolist(), order.tolist()
    size = [0] * n
    for a, b in zip(begin.tolist(), sizes.tolist(), strict=True):
        size[a] = b
    pointer = [-1] * n  # the nearest suffix on the left whose group is lower
    end = n
    while end > 1:
        low = group[line[end - 1]]
        members = sorted(line[low:end])
        end = low
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > low:
                p = pointer[p]
            if p >= 0 and group[p] == low:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, times in pointed.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[times]:
                own = group[p]
                size[own] -= 1
                last, at = own + size[own], place[p]
                if at != last:
                    other = line[last]
                    line[last], line[at], place[p], place[other] = p, other, last, at
                moved[own] = moved.get(own, 0) + 1
            for own, count in moved.items():
                start = own + size[own]
                size[start] = count
                if start != own:
                    for p in line[start : start + count]:
                        group[p] = start
    out, emitted, head = [n - 1] + [0] * (n - 1), bytearray(n), list(range(n))
    emitted[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not emitted[s]:
            emitted[s] = 1
            own = group[s]
            out[head[own]] = s
            head[own] += 1
            s = pointer[s]
    return out


# Bytes after which a token ends: white space, and some of those that make up other scripts.
_CUT = np.array([b <= 0x20 or (b >= 0x80 and b % 8 == 1) for b in range(256)])
LONGEST_TOKEN = 64


def repeated_starts(
    contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray, weights: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start within it, hash, repeated, first of its equals) of all strings of length bytes in the contexts.

    lefts: where the anchor stands in each context. A string is repeated if contexts of its group with a total weight of
    two or more have it at the same distance from the anchor."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    raw = b"\0".join(contexts) + b"\0"
    data = np.frombuffer(raw, np.uint8)
    separator = np.zeros(len(data), bool)
    separator[begins + sizes] = True

    def token_starts(cut: np.ndarray) -> np.ndarray:
        ends = cut[data] | separator
        ends[np.maximum(begins + sizes - 1, 0)] = True  # the separator is a token of its own
        return np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])

    starts = token_starts(_CUT)
    if np.diff(np.append(starts, len(data))).max() > min(LONGEST_TOKEN, length // 4):  # every string holds a token start
        starts = token_starts(np.ones(256, bool))
    ends = np.append(starts[1:], len(data))
    tokens = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    rank = {t: k + 2 for k, t in enumerate(sorted(set(tokens)))}
    symbols = np.array([rank[t] for t in tokens] + [0], np.int64)
    symbols[:-1][separator[starts]] = 1
    order = np.array(suffix_array(symbols), np.int64)

    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = starts - begins[owner[starts]]
    before = np.concatenate([[0], starts[:-1]])
    gap = np.minimum(starts - before, inside)  # strings that start in the gap have this token's start as their next
    last_start = (sizes - length)[owner[starts]]
    useful = (inside > 0) & ~separator[starts] & (inside - gap <= last_start)
    order = order[order < len(starts)]
    order = order[useful[order]]
    at, gap, own = starts[order], gap[order], owner[starts[order]]
    rest = begins[own] + sizes[own] - at

    windows = sliding_window_view(np.concatenate([data, np.zeros(length, np.uint8)]), length)
    common = np.zeros(len(at), np.int64)  # with the one before
    for k in range(1, len(at), 20_000):
        a, b = at[k : k + 20_000], at[k - 1 : k + 19_999][: len(at[k : k + 20_000])]
        differ = windows[a] != windows[b]
        common[k : k + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))

    rolling = Rolling(data)
    found: list[tuple[np.ndarray, ...]] = []
    for t in range(1, int(gap.max(initial=0)) + 1):
        kind = np.cumsum(common < length - t)
        start = at - t - begins[own]
        pick = np.flatnonzero((gap >= t) & (start >= 0) & (start <= (sizes - length)[own]))
        if not len(pick):
            continue
        c, s, absolute = own[pick], start[pick], at[pick] - t
        strings = kind[pick].astype(np.uint64) * np.uint64(ODD) + rolling.at(absolute, at[pick]) + np.uint64(t)
        found.append((c, s, rolling.at(absolute, absolute + length), *_counted(strings, c, s, lefts, groups, weights)))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(bool), empty.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(strings: np.ndarray, c: np.ndarray, s: np.ndarray, lefts: np.ndarray, groups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first of its equals) of the strings that start at s in the contexts c, by their classes and distances from the anchor."""
    key = mix(strings)
    key = mix(key + groups[c].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (lefts[c] - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    distinct, one, code = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(code, weights[c], len(distinct))
    first = np.zeros(len(key), bool)
    first[one] = True
    return total[code] >= 2, first


def repeated_unit_starts(
    contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray, weights: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """repeated_starts for units of eight bytes: every unit is a symbol, and every string starts at one."""
    sizes = np.array([len(c) // 8 for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(bytes(8).join(contexts) + bytes(8), np.uint64)
    separator = np.zeros(len(data), bool)
    separator[begins + sizes] = True
    symbols = np.ones(len(data) + 1, np.int64)
    symbols[:-1][~separator] = np.unique(data[~separator], return_inverse=True)[1] + 2
    symbols[-1] = 0
    order = np.array(suffix_array(symbols), np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = np.arange(len(data)) - begins[owner]
    at = order[order < len(data)]
    at = at[inside[at] <= (sizes - length)[owner[at]]]
    windows = sliding_window_view(np.concatenate([data, np.zeros(length, np.uint64)]), length)
    new = np.zeros(len(at), np.uint64)  # equal strings are neighbours in the order of the suffixes
    for k in range(1, len(at), 10_000):
        a = at[k : k + 10_000]
        new[k : k + 10_000] = (windows[a] != windows[at[k - 1 : k - 1 + len(a)]]).any(axis=1)
    c, s = owner[at], inside[at]
    return c, s, Rolling(data).at(at, at + length), *_counted(np.cumsum(new) * np.uint64(ODD), c, s, lefts, groups, weights)


class Bitmap:
    """Bits indexed by the low bits of a hash: 32 for each row of hashes (a written table), at most 2^29. It can say yes wrongly,
    never no."""

    LEAST, MOST = 16, 29

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = min(self.MOST, max(self.LEAST, (32 * hashes.count()).bit_length()))
        x = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        words = (
            hashes.select(F.shiftrightunsigned(x, 6).alias("w"), x.bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .groupBy("w")
            .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
            .toArrow()
        )
        bits = np.zeros(1 << (self.bits - 6), np.uint64)
        bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        self.sent = hashes.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "bits": self.bits}

    def has(self, x: np.ndarray) -> np.ndarray:
        i = x.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.sent.value[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes stay in the batch until a text's turn comes."""
    texts = batch.column(1)
    for key, text in zip(batch.column(0).to_pylist(), texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()), strict=True):
        yield key, np.frombuffer(text.as_py() or b"", np.uint8)


def _text_bits(keys: list[bytes]) -> np.ndarray:
    """32 bits of each text."""
    return mix(np.frombuffer(b"".join(keys), np.uint64)[::2]) >> np.uint64(32)


def _place_ids(key: bytes, at: np.ndarray) -> np.ndarray:
    """32 bits of the text, then 32 bits of the place in it: with the gram's hash they stand for a place."""
    low = mix(np.frombuffer(key, np.uint64)[1] + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD)) >> np.uint64(32)
    return (_text_bits([key]) << np.uint64(32) | low).view(np.int64)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, np.int64)


def covered_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = 1000, raw=_texts, starts=repeated_starts) -> DataFrame:
    """(key, spans): spans (start, end) of units to remove from the text of each key, a written table. keyed: (key, text), where
    key has 16 bytes and rows with equal keys have equal texts. raw gives the keys and units of a batch; starts is the suffix-array
    search for units of that size."""
    reach = length - gram

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [anchors(t, length, gram)[1] for _, t in raw(batch) if len(t) >= length]
        grams, n = np.unique(_flat(found), return_counts=True)
        return record_batch({"gram": (grams.view(np.int64), pa.int64()), "n": (n, pa.int64())})

    counted = map_batches(keyed, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = materialize(counted.select("gram"), "grams")
    repeated = Bitmap(counted, "gram")
    discard(counted)

    def context(text: np.ndarray, p: int) -> tuple[int, bytes]:
        begin = max(0, p - reach)
        return p - begin, text[begin : p + length].tobytes()

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, grams, hashes, places, ids = [], [], [], [], []
        for key, text in raw(batch):
            at, h = anchors(text, length, gram)
            hit = repeated.has(h)
            at, h = at[hit], h[hit]
            keys += [key] * len(at)
            grams.append(h.view(np.int64))
            places.append(at)
            ids.append(_place_ids(key, at))
            for p in at.tolist():
                left, own = context(text, p)
                hashes.append(int.from_bytes(hashlib.blake2b(own, digest_size=8, key=left.to_bytes(4, "little")).digest(), "little", signed=True))
        return record_batch(
            {
                "gram": (_flat(grams), pa.int64()),
                "context": (hashes, pa.int64()),
                "key": (keys, pa.binary()),
                "at": (_flat(places), pa.int64()),
                "place": (_flat(ids), pa.int64()),
            }
        )

    rows = materialize(map_batches(keyed, place, "gram long, context long, key binary, at long, place long"), "places")
    contexts = materialize(rows.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min("place").alias("place")), "contexts")
    # where every context occurs twice, all are covered whole and nothing is left to compare
    buckets = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").drop("least")
    wanted = materialize(contexts.join(buckets, "gram").select("gram", "context", "n", F.ceil(F.col("m") / bucket).alias("parts"), "place"), "wanted")
    want_place = Bitmap(wanted, "place")
    in_texts = materialize(wanted.select(F.shiftrightunsigned("place", 32).alias("h")).distinct(), "wanted-texts")
    want_text = Bitmap(in_texts, "h")
    discard(in_texts)

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(want_text.has(_text_bits(batch.column(0).to_pylist()))))
        keys, grams, places, ats, lefts, bodies = [], [], [], [], [], []
        for key, text in raw(batch):
            at, h = anchors(text, length, gram)
            ids = _place_ids(key, at)
            hit = want_place.has(ids) & repeated.has(h)
            keys += [key] * int(hit.sum())
            grams.append(h[hit].view(np.int64))
            places.append(ids[hit])
            ats += at[hit].tolist()
            for p in at[hit].tolist():
                left, own = context(text, p)
                lefts.append(left)
                bodies.append(own)
        return record_batch(
            {
                "gram": (_flat(grams), pa.int64()),
                "place": (_flat(places), pa.int64()),
                "key": (keys, pa.binary()),
                "at": (ats, pa.int64()),
                "left": (lefts, pa.int32()),
                "body": (bodies, pa.binary()),
            }
        )

    bodies = map_batches(keyed, cut_out, "gram long, place long, key binary, at long, left int, body binary")
    items = (
        wanted.join(bodies.dropDuplicates(["gram", "place"]), ["gram", "place"])
        .withColumn("part", F.pmod("context", "parts"))
        .repartition("gram", "part")
        .sortWithinPartitions("gram", "part")
        .select("gram", "part", "parts", "n", "key", "at", "left", "body")
    )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, or parts of buckets, half a megabyte at a time."""
        held: list[tuple] = []
        volume = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and volume > 500_000 and held[-1][:2] != row[:2]:
                    yield settle(held)
                    held, volume = [], 0
                held.append(row)
                volume += len(row[7])
        if held:
            yield settle(held)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        grams, parts, split, n, keys, at, left, body = (list(x) for x in zip(*held, strict=True))
        at, left, n = np.array(at, np.int64), np.array(left, np.int64), np.array(n, np.int64)
        numbers: dict = {}
        group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(grams, parts, strict=True)], np.int64)
        c, s, h, again, one = starts(body, left, group, np.minimum(n, 2), length)
        out: dict[str, list] = {k: [] for k in ("key", "start", "gram", "slot", "singles")}
        mine = again & (n[c] == 1)  # what occurs twice is covered whole elsewhere
        place = np.lexsort((s[mine], c[mine]))
        own, begin = c[mine][place], (at - left)[c[mine]][place] + s[mine][place]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(own) else []
        final = np.append(first[1:], len(own)) if len(own) else []
        for a, b in zip(first, final, strict=True):
            out["key"].append(keys[own[a]])
            out["start"].append([int(begin[a]), int(begin[b - 1]) + length])
            out["gram"].append(None), out["slot"].append(None), out["singles"].append(None)
        many = np.array(split, np.int64)
        loose = np.flatnonzero(one & (many[c] > 1))
        if len(loose):  # a part of a bucket: each different string may stand in another part too
            lc, mixed = c[loose], mix(h[loose] + (left[c[loose]] - s[loose]).astype(np.uint64) * np.uint64(ODD))
            slot = (mixed % many[lc].astype(np.uint64)).astype(np.int64)
            bucket_of = np.array(grams, np.int64)[lc]
            order = np.lexsort((slot, bucket_of))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(bucket_of[order]) != 0) | (np.diff(slot[order]) != 0)]))
            for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
                i = order[a:b]
                absolute = (at - left)[lc[i]] + s[loose][i]
                packed = np.stack([mixed[i].view(np.int64), *np.frombuffer(b"".join([keys[k] for k in lc[i]]), np.int64).reshape(-1, 2).T, absolute], axis=1)
                out["key"].append(None), out["start"].append(None)
                out["gram"].append(int(bucket_of[i[0]])), out["slot"].append(int(slot[i[0]])), out["singles"].append(packed.tobytes())
        return record_batch(
            {
                "key": (out["key"], pa.binary()),
                "start": (out["start"], pa.list_(pa.int64())),
                "gram": (out["gram"], pa.int64()),
                "slot": (out["slot"], pa.int64()),
                "singles": (out["singles"], pa.binary()),
            }
        )

    settled = materialize(items.mapInArrow(resolve, "key binary, start array<long>, gram long, slot long, singles binary"), "settled")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of one slot of a split bucket, from all its parts."""
        held: list[bytes] = []
        now = None

        def done() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), np.int64).reshape(-1, 4)
            _, code, n = np.unique(x[:, 0], return_inverse=True, return_counts=True)
            again = x[n[code] > 1]
            keys = [k.tobytes() for k in again[:, 1:3]]
            return record_batch({"key": (keys, pa.binary()), "start": ([[int(s), int(s) + length] for s in again[:, 3]], pa.list_(pa.int64()))})

        for batch in batches:
            for gram_, slot, singles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (gram_, slot) != now:
                    yield done()
                    held.clear()
                now = (gram_, slot)
                held.append(singles)
        if held:
            yield done()

    loose = settled.filter("singles is not null").select("gram", "slot", "singles")
    met = loose.repartition("gram", "slot").sortWithinPartitions("gram", "slot").mapInArrow(meet, "key binary, start array<long>")
    whole = rows.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"]).select(
        "key", F.array(F.greatest(F.lit(0), F.col("at") - reach), F.col("at") + length).alias("start")
    )
    spans = whole.union(settled.filter("key is not null").select("key", "start")).union(met)
    found = materialize(spans.groupBy("key").agg(F.collect_set("start").alias("spans")), "spans")
    discard(rows, contexts, wanted, settled)
    return found


def merged(spans: list | None, size: int) -> list[tuple[int, int]]:
    """Disjoint maximal runs, cut to size."""
    out: list[list[int]] = []
    for a, b in sorted(spans or ()):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, str]:
    """docs with a column (its name is returned) of the byte spans to remove, unmerged and in no order."""
    key, spans = clean_name(docs, "_key"), clean_name(docs, "_spans")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    gram = GRAM if length == LENGTH else max(1, length * 5 // 8)
    found = covered_spans(keyed.select(F.col(key).alias("key"), F.col(text).alias("text")), length, gram)
    return keyed.join(found.toDF(key, spans), key, "left").drop(key), spans


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """What is removed from each text, and the hash of what stays."""
    marked, spans = with_spans(docs.select(doc_id, text), doc_id, text, length)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (t or "").encode()
            runs = merged(s, len(raw))
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        n, removed, count, sha = zip(*rows, strict=True) if rows else [()] * 4
        return record_batch(
            {
                "doc_id": (batch.column(0).cast(pa.int64()), pa.int64()),
                "n_bytes": (n, pa.int64()),
                "n_removed": (removed, pa.int64()),
                "n_spans": (count, pa.int64()),
                "kept_sha256": (sha, pa.string()),
            }
        )

    return map_batches(marked.select(doc_id, text, spans), run, DIGEST)


_PARTIAL = re.compile(rb"[\x80-\xBF]*")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with their texts cut. A span shrinks to whole characters. A null text stays null."""
    marked, spans = with_spans(docs, doc_id, text, length)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, s: object) -> str | None:
            if t is None or s is None:
                return t
            raw, out, at = t.encode(), [], 0
            for a, b in merged([tuple(x) for x in s], len(raw)):
                a = _PARTIAL.match(raw, a).end()
                while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                    b -= 1
                if a < b:
                    out.append(raw[at:a])
                    at = b
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return marked.withColumn(text, cut(F.col(text), F.col(spans))).select(*docs.columns)
