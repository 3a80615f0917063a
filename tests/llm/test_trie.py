"""op11: the trie of rebuilt conversations against one that is written out node by node."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        parent = min(nodes[path[:-1]]) if path else None
        children = sum(len(q) == len(path) + 1 for q in below)
        out.append((min(members), len(path), parent, len(members), children, len(childless), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, schema=SCHEMA):
    df = ct.prefix_trie(spark.createDataFrame(rows, schema))
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def chatter(seed, conversations=150, texts=4):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), conversations):
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(["word"] * rng.randrange(texts))))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def scattered(spark):
    """Partitions stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_over_many_partitions(scattered, seed):
    rows = chatter(seed)
    assert trie(scattered, rows) == plain(rows)


def test_odd_conversations(scattered):
    same = [(100 + c, t, "user", f"hello {t}") for c in range(40) for t in range(5)]
    odd = [
        (None, 0, "user", "nobody"), (1, None, "user", "before the first"), (1, 0, None, "x"), (1, 0, None, "x"), (1, 0, "", None),
        (2, 5, "user", "  \n"), (3, 0, "user", "w " * 5000), (20, 0, "user", "base"), (-1, 0, "user", "base"), (-20, 0, "user", "base"), (39, 1, "a", "b"),
    ]
    long = [(500, t, "user", f"turn {t % 7}") for t in range(300)] + [(501, t, "user", f"turn {t % 7}") for t in range(299)]
    rows = same + odd + long
    assert trie(scattered, rows) == plain(rows)


def test_only_turnless_conversations(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_and_clashing_names(spark):
    assert trie(spark, []) == []
    rows = chatter(3, 30)
    names = "own base head h key node n least part flag before after suffix at words code".split()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in names})
    assert sorted(map(tuple, ct.prefix_trie(df).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_parts_add_up_wherever_they_are_cut(blocks):
    """The nodes of all partitions, those that several share summed up, are those of one partition."""
    rng = random.Random(blocks)

    def unit(x):
        return hashlib.md5(bytes([x])).digest() + x.to_bytes(8, "big")

    keys = sorted({b"".join(unit(rng.randrange(3)) for _ in range(rng.randrange(7))) for _ in range(300)})
    cuts = [0, *sorted(rng.sample(range(1, len(keys)), blocks - 1)), len(keys)]

    def expanded(parts):
        done = {}
        for part, before, after in parts:
            tree = ct.Patricia(before, after)
            for k in part:
                tree.add(k, 1 + len(k) % 5, keys.index(k))
            tree.finish()
            for node, parent, depth, n, least, children, leaves, a, b, suffix, shared in tree.rows:
                assert not shared or len(suffix) == 1
                if node in done:
                    m = done[node]
                    assert shared
                    done[node] = (depth, n + m[1], min(least, m[2]), children + m[3], leaves + m[4], a + m[5], b + m[6], list(suffix)[-1:])
                else:
                    done[node] = (depth, n, least, children, leaves, a, b, list(suffix)[-1:])
        return done

    whole = expanded([(keys, None, None)])
    parts = expanded([(keys[i:j], keys[i - 1] if i else None, keys[j] if j < len(keys) else None) for i, j in zip(cuts, cuts[1:])])
    assert {k: v for k, v in parts.items() if k in whole} == whole
