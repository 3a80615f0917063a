"""Exact top-k inner-product search with paged M-trees, best-first.

Maximum inner product becomes nearest neighbour in a metric space by one more coordinate: a row x gets sqrt(M - |x|^2), where M is the
greatest |x|^2 of its length, a query gets 0. All rows then lie on one sphere, and q.x = |q| sqrt(M) cos(angle). The metric is the
angle, whose triangle inequality is tighter on a sphere than that of straight distances.

A bounded sample of rows gives pivots. Each row goes to the cell of its nearest pivot, and cells are cut into blocks of bounded size.
Each block is built once into an M-tree of two levels of pages and written: a leaf page has a routing row, a covering radius and
its members in the order of their distances to the routing row (the parent distances); leaf pages hang below upper pages in the same way.

Queries travel in blocks too, by home cell. First each meets one tree of its home cell, which gives a k-th score for every query. With it a
query goes on only to the cells whose pivot and covering radius allow a score as high, and there visits the pages in the order of their
least possible distance (best-first), until that exceeds its k-th best so far. An upper page rules out its leaf pages by their stored
parent distances before any distance to their routing rows is computed, and of a leaf page only the members are multiplied whose parent
distance lies within reach. All queries of a block advance in step: in each round every one visits its next page, and those
that visit the same page share one product. Where vectors have no clusters, no bound can rule out anything and every query sees all rows.

Scores are integers: products are exact as doubles below 2^53, as 64-bit integers below 2^63, and an input whose scores could be greater
is an error. Bounds are widened by 1e-7 of the greatest score, far more than their rounding.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part. A query whose length differs
from a row's doesn't meet that row. Repeated ids are separate rows and separate queries, except that a query never meets a row with its
own id. Ties go to the smaller id. Fewer rows than k: all are returned. Only the two columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, record_batch

SLACK = 1e-7
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def quantized(vectors: DataFrame, vec_id: str, vector: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double, of the usable rows."""
    return vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
    )


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def lifted(rows: np.ndarray, bound: float) -> np.ndarray:
    """Unit vectors of the rows with their extra coordinate. bound: the greatest squared length."""
    x = rows.astype(float) / np.sqrt(bound or 1.0)
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1)))[:, None]])


def unit(queries: np.ndarray) -> np.ndarray:
    q = queries.astype(float)
    return np.hstack([q / np.maximum(np.sqrt((q**2).sum(1)), 1e-300)[:, None], np.zeros((len(q), 1))])


class MTree:
    """Two levels of pages over the rows of one block. bound: the greatest squared length of all blocks' rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bound: float, leaf: int = 256, fan: int = 16):
        self.root = float(np.sqrt(bound))
        points = lifted(rows, bound)
        # members are dealt by bisection between two far rows, so that pages are compact and full
        pages, routes, parents = [], [], []
        for page in self._cut(points, np.arange(len(rows)), leaf):
            own = points[page]
            route = own[int((own @ own.mean(axis=0)).argmax())]
            near = _angles(own, route[None])[:, 0]
            order = np.argsort(near, kind="stable")
            pages.append(page[order])
            routes.append(route)
            parents.append(near[order])
        order = np.concatenate(pages)
        fits = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= rows.min() and rows.max() <= np.iinfo(t).max)
        self.ids, self.rows, self.parents = ids[order], rows[order].astype(fits), np.concatenate(parents)
        self.ends = np.cumsum([len(p) for p in pages])
        self.routes = np.array(routes)
        self.radius = np.array([p[-1] for p in parents])
        self.upper = self._cut(self.routes, np.arange(len(pages)), fan)
        self.upper_routes = np.array([self.routes[g[0]] for g in self.upper])
        self.page_distance = [_angles(self.routes[g], r[None])[:, 0] for g, r in zip(self.upper, self.upper_routes, strict=True)]
        self.upper_radius = np.array([(d + self.radius[g]).max() for g, d in zip(self.upper, self.page_distance, strict=True)])
        self.seen_pages = self.seen_rows = 0

    @staticmethod
    def _cut(points: np.ndarray, items: np.ndarray, size: int) -> list[np.ndarray]:
        todo, done = [items], []
        while todo:
            part = todo.pop()
            if len(part) <= size:
                done.append(part)
                continue
            own = points[part]
            a = (own @ own[0]).argmin()
            b = (own @ own[a]).argmin()
            order = np.argsort(own @ (own[b] - own[a]), kind="stable")
            todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        return done

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's k best rows without its own id, in order, of those that score ``least`` or more."""
        exact = float if np.abs(queries).max(initial=0) * float(np.abs(self.rows.astype(float)).max()) * queries.shape[1] < 2**53 else np.int64
        rows, asked, q = self.rows.astype(exact), queries.astype(exact), unit(queries)
        scale = np.sqrt((queries.astype(float) ** 2).sum(1)) * self.root
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        kth = least.copy()

        def reach(i: np.ndarray) -> np.ndarray:
            """The greatest angle at which a row can still enter."""
            cosine = kth[i].astype(float) / np.maximum(scale[i], 1e-300) - SLACK
            return np.where((kth[i] == NONE) | (scale[i] == 0), np.pi, np.arccos(np.clip(cosine, -1.0, 1.0)))

        allowed = reach(np.arange(len(queries)))
        theta = np.full((len(queries), len(self.routes)), np.inf)
        above = _angles(q, self.upper_routes)
        for j, pages in enumerate(self.upper):
            by_parent = np.abs(above[:, j, None] - self.page_distance[j]) - self.radius[pages]
            open_ = (by_parent <= allowed[:, None]) & (above[:, j] - self.upper_radius[j] <= allowed)[:, None]
            who, what = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if len(who):
                own = _angles(q[who], self.routes[pages[what]])
                theta[np.ix_(who, pages[what])] = np.where(open_[np.ix_(who, what)], own, np.inf)
        nearest = np.maximum(0.0, theta - self.radius)
        order = np.argsort(nearest, axis=1, kind="stable")
        active = np.arange(len(queries))
        for turn in range(len(self.routes)):
            page = order[active, turn]
            go = nearest[active, page] <= allowed[active]
            active, page = active[go], page[go]
            if not len(active):
                break
            for p in np.unique(page).tolist():
                who = active[page == p]
                begin, end = (self.ends[p - 1] if p else 0), self.ends[p]
                near, reached = theta[who, p], allowed[who]
                a = begin + np.searchsorted(self.parents[begin:end], (near - reached).min(), "left")
                b = begin + np.searchsorted(self.parents[begin:end], (near + reached).max(), "right")
                self.seen_pages += len(who)
                self.seen_rows += len(who) * int(b - a)
                scores = asked[who] @ rows[a:b].T
                enter = scores >= kth[who][:, None]
                for i in np.flatnonzero(enter.any(1)).tolist():
                    at = np.flatnonzero(enter[i])
                    at = at[self.ids[a:b][at] != own_ids[who[i]]]
                    s, x = best[who[i]]
                    s, x = np.concatenate([s, scores[i, at].astype(np.int64)]), np.concatenate([x, self.ids[a:b][at]])
                    first = np.lexsort((x, -s))[:k]
                    best[who[i]] = s[first], x[first]
                    if len(first) == k:
                        kth[who[i]] = max(kth[who[i]], s[first[-1]])
                allowed[who] = reach(who)
        return best


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, rows) of the vectors (vec_id, v) of each length."""
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        own = batch.filter(pa.array(sizes == dim))
        yield dim, own.column("vec_id").to_numpy(), own.column("v").flatten().to_numpy().reshape(-1, dim)


class Pivots:
    """For each length the greatest squared length and at most ``most`` unit vectors, far from each other, of a sample of at most
    ``sample`` rows (and 64 MB)."""

    def __init__(self, rows: DataFrame, per_block: int, most: int = 256, sample: int = 2048):
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        greatest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
        by = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("bound"), F.max(greatest).alias("most"))
        self.bound, self.points, wanted = {}, {}, []
        for r in by.collect():
            if r["dim"] * r["most"] ** 2 >= 2**63:
                raise ValueError(f"scores of vectors of length {r['dim']} with components up to {r['most']:.0f} can exceed 64 bits")
            self.bound[r["dim"]] = r["bound"]
            take = min(sample, max(1, (64 << 20) // (8 * r["dim"])))
            wanted.append((r["dim"], int(min(1.0, take / r["n"]) * (1 << 31)), min(most, -(-r["n"] // per_block))))
        if not wanted:
            return
        spark = rows.sparkSession
        shares = F.broadcast(spark.createDataFrame([w[:2] for w in wanted], "dim int, share long"))  # a row for each length
        low = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 31))
        picked = rows.join(shares, F.size("v") == F.col("dim")).filter(low < F.col("share")).select("dim", "v").distinct().collect()
        for dim, _, n in wanted:
            own = sorted(r["v"] for r in picked if r["dim"] == dim)
            points = lifted(np.array(own or [[0] * dim], np.int64), self.bound[dim])
            chosen, nearest = [0], points @ points[0]
            while len(chosen) < min(n, len(points)):  # the farthest from all chosen ones
                chosen.append(int(nearest.argmin()))
                nearest = np.maximum(nearest, points @ points[chosen[-1]])
            self.points[dim] = points[chosen]


def _blocks(rows: DataFrame, pivots: Pivots, per_block: int, name: str, lift) -> DataFrame:
    """(dim, cell, part, parts, ids, flat): rows by their nearest pivot, in parts of about per_block rows."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for dim, ids, own in _vectors(batch):
                cells = (lift(own, pivots.bound[dim]) @ pivots.points[dim].T).argmax(1) if dim in pivots.bound else np.zeros(len(own), np.int64)
                ends = np.arange(len(own) + 1, dtype=np.int32) * dim
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel()))
                yield record_batch({"cell": (cells, pa.int32()), "turn": (np.arange(turn, turn + len(own)), pa.int64()), "vec_id": (ids, pa.int64()), "v": (lists, lists.type)})
                turn += len(own)

    dealt = materialize(rows.select("vec_id", "v").mapInArrow(assign, "cell int, turn long, vec_id long, v array<long>"), f"{name}-cells")
    dealt = dealt.withColumn("dim", F.size("v"))
    # at most as many rows as there are pivots: every row of a cell takes its turn, so that equal rows don't meet in one part
    counts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / per_block).alias("parts"))
    parted = dealt.join(F.broadcast(counts), ["dim", "cell"]).withColumn("part", F.pmod("turn", "parts"))
    packed = parted.groupBy("dim", "cell", "part", "parts").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return packed.select("dim", "cell", "part", "parts", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("flat"))


TREE = "dim int, cell int, part long, parts long, radius double, tree binary"
ASKED = "dim int, cell int, part long, salt long, asked long, tree binary, ixs binary, ids binary, flat binary, least binary"
FOUND = "asked long, ix int, query_id long, vec_id long, score long"


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, per_block: int = 8192, per_query_block: int = 1024, together: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the greatest inner product with each query.

    queries and rows: (vec_id, v) with integer components. together: query blocks that one task takes to a tree."""
    pivots = Pivots(rows.select("vec_id", "v").unionByName(queries.select("vec_id", "v")), per_block)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cell, part, parts, ids, flat in zip(*batch.columns, strict=True):
                d = dim.as_py()
                own = flat.values.to_numpy().reshape(-1, d)
                tree = MTree(ids.values.to_numpy(), own, pivots.bound[d])
                radius = _angles(lifted(own, pivots.bound[d]), pivots.points[d][cell.as_py()][None]).max()
                values = (d, cell.as_py(), part.as_py(), parts.as_py(), float(radius), pickle.dumps(tree))
                yield record_batch({c.split(" ")[0]: ([x], t) for c, x, t in zip(TREE.split(", "), values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)})

    trees = materialize(_blocks(rows, pivots, per_block, "rows", lifted).mapInArrow(build, TREE), "trees")
    asked = _blocks(queries, pivots, per_query_block, "queries", lambda own, _: unit(own))
    asked = materialize(asked.select("dim", "cell", "ids", "flat", F.monotonically_increasing_id().alias("asked")), "asked")
    cells: dict[int, dict[int, tuple[float, int]]] = {}  # a radius and a number of parts for each pivot
    for r in trees.groupBy("dim", "cell").agg(F.max("radius").alias("radius"), F.max("parts").alias("parts")).collect():
        cells.setdefault(r["dim"], {})[r["cell"]] = r["radius"], r["parts"]
    salts = max(1, -(-asked.count() // together))

    def out(dim: int, cell: int, part: int, number: int, ixs: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple:
        return dim, cell, part, number % salts, number, None, *(np.ascontiguousarray(x, np.int64).tobytes() for x in (ixs, ids, own, least))

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        columns = zip(*rows, strict=True) if rows else [()] * 10
        return record_batch({c.split(" ")[0]: (list(x), t) for c, x, t in zip(ASKED.split(", "), columns, kinds, strict=True)})

    def home(dim: int, cell: int, number: int) -> tuple[int, int] | None:
        """The one tree that a query block meets first."""
        there = cells.get(dim)
        if not there:
            return None
        cell = cell if cell in there else min(there)
        return cell, number % there[cell][1]

    def go_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cell, ids, flat, number in zip(*batch.columns, strict=True):
                at = home(dim.as_py(), cell.as_py(), number.as_py())
                if at:
                    ids, own = ids.values.to_numpy(), flat.values.to_numpy()
                    yield sent([out(dim.as_py(), *at, number.as_py(), np.arange(len(ids)), ids, own, np.full(len(ids), NONE))])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a block that a cell may still hold something for, for every part of the cell but the one they have met."""
        for batch in batches:
            for dim, cell, ids, flat, number, ixs, kth in zip(*batch.columns, strict=True):
                d, n = dim.as_py(), number.as_py()
                at = home(d, cell.as_py(), n)
                ids, own = ids.values.to_numpy(), flat.values.to_numpy().reshape(-1, d)
                least = np.full(len(ids), NONE)
                if ixs.as_py():
                    least[ixs.values.to_numpy()] = kth.values.to_numpy()
                scale = np.sqrt((own.astype(float) ** 2).sum(1) * pivots.bound[d])
                angle = _angles(unit(own), pivots.points[d])
                for c, (radius, parts) in sorted(cells.get(d, {}).items()):
                    most = scale * (np.cos(np.maximum(0.0, angle[:, c] - radius)) + SLACK)
                    who = np.flatnonzero((least == NONE) | (most >= least))
                    if len(who):
                        for part in range(parts):
                            if (c, part) != at:
                                yield sent([out(d, c, part, n, who, ids[who], own[who], least[who])])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tree, then the query blocks that meet it."""
        tree = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["tree"] is not None:
                    tree, of = pickle.loads(row["tree"]), (row["dim"], row["cell"], row["part"])
                    continue
                if tree is None or of != (row["dim"], row["cell"], row["part"]):
                    continue  # that part of the cell has no rows
                ixs, ids, flat, least = (np.frombuffer(row[c], np.int64) for c in ("ixs", "ids", "flat", "least"))
                found = tree.search(ids, flat.reshape(len(ids), -1), k, least)
                n = [len(s) for s, _ in found]
                yield record_batch(
                    {
                        "asked": (np.full(sum(n), row["asked"]), pa.int64()),
                        "ix": (np.repeat(ixs, n), pa.int32()),
                        "query_id": (np.repeat(ids, n), pa.int64()),
                        "vec_id": (np.concatenate([x for _, x in found]), pa.int64()),
                        "score": (np.concatenate([s for s, _ in found]), pa.int64()),
                    }
                )

    def met(pairs: DataFrame) -> DataFrame:
        """Every tree goes to as many tasks as its query blocks are dealt to, once to each, before them."""
        dealt = trees.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        wanted = pairs.select("dim", "cell", "part", "salt").distinct()
        dealt = dealt.join(wanted, ["dim", "cell", "part", "salt"], "left_semi")
        none = {c: F.lit(None).cast("binary") for c in ("ixs", "ids", "flat", "least")}
        first = dealt.withColumns({"asked": F.lit(-1).cast("long"), **none}).select(*pairs.columns)
        key = ["dim", "cell", "part", "salt"]
        return first.unionByName(pairs).repartition(*key).sortWithinPartitions(*key, "asked").mapInArrow(search, FOUND)

    homes = materialize(asked.mapInArrow(go_home, ASKED), "home-pairs")
    at_home = materialize(met(homes), "home")
    # the k-th score of the queries that have k already
    reached = at_home.groupBy("asked", "ix").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    lists = reached.groupBy("asked").agg(F.collect_list(F.struct("ix", "kth")).alias("r")).select("asked", F.col("r.ix").alias("ixs"), F.col("r.kth").alias("kth"))
    going = asked.join(lists, "asked", "left").select("dim", "cell", "ids", "flat", "asked", "ixs", "kth")
    pairs = materialize(going.mapInArrow(go_on, ASKED), "pairs")
    found = materialize(at_home.unionByName(met(pairs)), "found")
    discard(homes, at_home, pairs, trees, asked)
    order = Window.partitionBy("asked", "ix").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
