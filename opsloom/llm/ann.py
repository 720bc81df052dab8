"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, merged over the shards.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. A shard keeps its distinct vectors and one flat
array of neighbours per layer; equal vectors are one graph node with many ids, so a vector that fills a third of the table
doesn't crowd the graph. The largest inner product becomes a nearest neighbour by one more coordinate, the rest of the
shard's largest norm. A shard holds vectors of one norm class, scaled by its largest component, and queries are scaled by
theirs: a vector much longer than the others would leave nothing of their differences in single precision. Nodes enter in blocks: a block is searched in the graph as it stands, its members also see each
other, and each link is chosen so that it is nearer to the node than to the links already taken.

Queries meet each shard in blocks; a task holds one shard and one block of queries. Scores are inner products of the
original vectors in double precision. Spark merges the shards' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import work_path

SHARD_ROWS = 8_192
QUERY_ROWS = 16_384
#: Links of a node: on the upper layers, and twice as many on the lowest.
LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH = 96, 160
#: Nodes searched together.
TOGETHER = 256
#: Norms of a class differ by less than this power of two; norms around 1 are inside one class.
NORM_BITS = 4


def _levels(n: int, links: int) -> np.ndarray:
    """Layer of each node: every further layer has 1 / links of the nodes, by a fixed permutation."""
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    levels = np.zeros(n, dtype=np.int64)
    size = n // links
    while size >= 1:
        levels[order[:size]] += 1
        size //= links
    return levels


class Graph:
    """Layers of flat neighbour arrays over the rows of ``points``; -1 pads."""

    def __init__(self, points: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> None:
        self.points = points
        self.norms = np.einsum("ij,ij->i", points, points)
        self.links, self.width = links, width
        self.layers: list[np.ndarray] = []
        self.entry = -1

    # --- distances --------------------------------------------------------------------------
    def _far(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance, less the query's norm, of each query to its row of nodes; padding is infinitely far."""
        dots = np.einsum("bd,bmd->bm", queries, self.points[nodes])
        return np.where(nodes >= 0, self.norms[nodes] - 2 * dots, np.inf)

    def search_layer(self, layer: np.ndarray, queries: np.ndarray, pool: np.ndarray, far: np.ndarray, width: int):
        """Best-first search of many queries: pools of ``width`` nodes, nearest first."""
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.points) + 1), dtype=bool)  # the last column takes the padding
        seen[rows[:, None], pool] = True
        done = np.isinf(far)
        live = rows
        while len(live):
            step = np.where(done[live], np.inf, far[live])
            best = step.argmin(axis=1)
            go = np.isfinite(step[np.arange(len(live)), best])
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = layer[pool[live, best]]
            new = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], new] = True
            apart = self._far(queries[live], new)
            nodes = np.concatenate((pool[live], new), axis=1)
            distances = np.concatenate((far[live], apart), axis=1)
            marks = np.concatenate((done[live], np.isinf(apart)), axis=1)
            if nodes.shape[1] > width:
                order = np.argpartition(distances, width - 1, axis=1)[:, :width]
                nodes, distances, marks = (np.take_along_axis(x, order, 1) for x in (nodes, distances, marks))
            if nodes.shape[1] > pool.shape[1]:
                grown = nodes.shape[1] - pool.shape[1]
                pool = np.pad(pool, ((0, 0), (0, grown)), constant_values=-1)
                far = np.pad(far, ((0, 0), (0, grown)), constant_values=np.inf)
                done = np.pad(done, ((0, 0), (0, grown)), constant_values=True)
            pool[live], far[live], done[live] = nodes, distances, marks
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pools of the lowest layer: greedy through the upper layers, then ``width`` wide."""
        pool = np.full((len(queries), 1), self.entry, dtype=np.int64)
        far = self._far(queries, pool)
        for layer in reversed(self.layers[1:]):
            pool, far = self.search_layer(layer, queries, pool, far, 4)
        return self.search_layer(self.layers[0], queries, pool, far, width)

    # --- building ---------------------------------------------------------------------------
    def _choose(self, nodes: np.ndarray, pool: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Diverse links: a candidate stays if it is nearer to the node than to all that stay; the rest fills up."""
        far = far + self.norms[nodes][:, None]
        size = pool.shape[1]
        points = self.points[pool]
        kept = np.zeros(pool.shape, dtype=bool)
        valid = np.isfinite(far)
        norms = self.norms[pool]
        gaps = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        for c in range(size):
            blocked = (kept & (gaps[:, :, c] < far[:, c][:, None])).any(axis=1)
            kept[:, c] = valid[:, c] & ~blocked & (kept.sum(axis=1) < most)
        rank = np.argsort(np.where(valid, np.where(kept, 0, 1), 2) * size + np.arange(size), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(pool, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _connect(self, layer: np.ndarray, nodes: np.ndarray, links: np.ndarray) -> None:
        """Write the nodes' links and their reverses; a full list is chosen anew."""
        most = layer.shape[1]
        layer[nodes, : links.shape[1]] = links
        target, origin = links.ravel(), np.repeat(nodes, links.shape[1])
        target, origin = target[target >= 0], origin[target >= 0]
        order = np.argsort(target, kind="stable")
        target, origin = target[order], origin[order]
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
        hubs = target[starts]
        counts = np.diff(np.append(starts, len(target)))
        place = np.arange(len(target)) - np.repeat(starts, counts)
        for at in range(0, len(hubs), TOGETHER):
            some, size = hubs[at:at + TOGETHER], counts[at:at + TOGETHER]
            wide = np.full((len(some), int(size.max())), -1, dtype=np.int64)
            low, high = starts[at], starts[at] + int(size.sum())
            wide[np.repeat(np.arange(len(some)), size), place[low:high]] = origin[low:high]
            both = np.concatenate((layer[some], wide), axis=1)
            both = np.sort(both, axis=1)[:, ::-1]  # equal neighbours side by side, padding last
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            free = (both >= 0).sum(axis=1) <= most
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            rows = some[free]
            layer[rows, : min(most, packed.shape[1])] = packed[free][:, :most]
            if (~free).any():
                rows, packed = some[~free], packed[~free]
                far = self._far(self.points[rows], packed)
                order = np.argsort(far, axis=1, kind="stable")
                layer[rows] = self._choose(rows, np.take_along_axis(packed, order, 1), np.take_along_axis(far, order, 1), most)

    def build(self) -> "Graph":
        n = len(self.points)
        levels = _levels(n, self.links)
        height = int(levels.max()) + 1
        self.layers = [np.full((n, self.links * (2 if k == 0 else 1)), -1, dtype=np.int64) for k in range(height)]
        # Highest first, so the upper layers stand before the lower ones fill.
        order = np.argsort(-levels, kind="stable")
        self.entry = int(order[0])
        at = 1
        while at < n:
            block = order[at:at + max(1, min(TOGETHER, at // 4))]
            at += len(block)
            pool = np.full((len(block), 1), self.entry, dtype=np.int64)
            far = self._far(self.points[block], pool)
            for k in range(height - 1, -1, -1):
                mine = np.flatnonzero(levels[block] >= k)
                if not len(mine):
                    pool, far = self.search_layer(self.layers[k], self.points[block], pool, far, 4)
                    continue
                pool, far = self.search_layer(self.layers[k], self.points[block], pool, far, self.width)
                nodes = block[mine]
                peers = np.broadcast_to(nodes, (len(nodes), len(nodes))).copy()
                np.fill_diagonal(peers, -1)
                wide = np.concatenate((pool[mine], peers), axis=1)
                apart = np.concatenate((far[mine], self._far(self.points[nodes], peers)), axis=1)
                near = np.argsort(apart, axis=1, kind="stable")[:, : self.width]
                wide, apart = np.take_along_axis(wide, near, 1), np.take_along_axis(apart, near, 1)
                self._connect(self.layers[k], nodes, self._choose(nodes, wide[:, : 2 * self.links], apart[:, : 2 * self.links], self.links))
        return self


# --- Spark -------------------------------------------------------------------------------------

def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, all components finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))


def norm_class(vector: str | Column) -> Column:
    """Number of the class of a usable vector's norm. Components are divided by the largest, so that no square overflows."""
    c = F.col(vector) if isinstance(vector, str) else vector
    most = F.array_max(F.transform(c, F.abs))
    squares = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return F.floor((F.log2(most) + F.log2(squares) / 2 + NORM_BITS / 2) / NORM_BITS)


def _points(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one norm class in single precision, scaled, with the coordinate that brings all to the largest norm."""
    points = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", points, points)
    return np.concatenate((points, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]), axis=1).astype(np.float32)


INDEX = "node int, shard bigint, dims int, ids array<bigint>, vector array<double>, levels array<array<int>>, entry boolean"


def _build(links: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        dims = table.column("dims")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)
        order = np.lexsort(ids[None, :])
        ids, vectors = ids[order], vectors[order]
        distinct, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.ravel()
        graph = Graph(_points(distinct), links, width).build()
        members: list[list[int]] = [[] for _ in distinct]
        for i, w in zip(ids.tolist(), where.tolist()):
            members[w].append(i)
        n = len(distinct)
        layers = [[layer[i].tolist() for layer in graph.layers] for i in range(n)]
        return pa.table({
            "node": pa.array(np.arange(n, dtype=np.int32)), "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int64()),
            "dims": pa.array([dims] * n, pa.int32()), "ids": pa.array(members, pa.list_(pa.int64())),
            "vector": pa.array(list(distinct), pa.list_(pa.float64())), "levels": pa.array(layers, pa.list_(pa.list_(pa.int32()))),
            "entry": pa.array((np.arange(n) == graph.entry).tolist())})

    return run


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS,
                links: int = LINKS, width: int = BUILD_WIDTH) -> None:
    """Write the index of all usable vectors: one row per node, with its ids, vector and flat neighbours on every layer.

    Rows with a null key, and vectors that are null, empty, zero or hold a null or non-finite component, are left out.
    Vectors of different numbers of components, and of different norm classes, go to different shards. Repeated rows count once.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.size(vector).alias("dims"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("norm", norm_class("vector"))
    sizes = rows.groupBy("dims", "norm").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    placed = rows.join(sizes, ["dims", "norm"]).withColumn(
        "shard", F.col("norm") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), "shards")).drop("shards", "norm")
    # A given number of partitions: a shard is little data but much work, and should not share its task.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = placed.dropDuplicates(["shard", "dims", "id", "vector"]).repartition(parts, "dims", "shard")
    distinct.groupBy("dims", "shard").applyInArrow(_build(links, width), INDEX).write.parquet(path)


def _search(top: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.combine_chunks()
        order = np.argsort(left.column("node").to_numpy(), kind="stable")
        left = left.take(pa.array(order))
        n, dims = left.num_rows, left.column("dims")[0].as_py()
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat(left, "vector").reshape(n, dims)
        graph = Graph(_points(vectors))
        height = len(left.column("levels")[0])
        levels = left.column("levels").combine_chunks().flatten()
        graph.layers = []
        for k in range(height):
            rows = levels.take(pa.array(np.arange(n) * height + k)).flatten().to_numpy(zero_copy_only=False)
            graph.layers.append(rows.astype(np.int64).reshape(n, -1))
        graph.entry = int(np.flatnonzero(left.column("entry").to_numpy(zero_copy_only=False))[0])
        members = left.column("ids")
        keys = right.column("id").to_numpy()
        queries = right.combine_chunks().column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), dims)
        out_q, out_v, out_s = [], [], []
        # One more than asked for: the query itself may be among them.
        for at in range(0, len(keys), TOGETHER):
            some = queries[at:at + TOGETHER]
            unit = (some / np.abs(some).max(axis=1, keepdims=True)).astype(np.float32)
            wide = np.concatenate((unit, np.zeros((len(some), 1), np.float32)), axis=1)
            pool, far = graph.search(wide, max(width, 2 * top))
            for row, (query, key) in enumerate(zip(some, keys[at:at + TOGETHER].tolist())):
                found = pool[row][np.isfinite(far[row])]
                scores = (vectors[found] * query).sum(axis=1)
                near: list[tuple[float, int]] = []
                last = -np.inf
                # Nodes of one score are taken together: which of their ids come first is for the ids to say.
                for i in np.argsort(-scores, kind="stable"):
                    if len(near) >= top and scores[i] < last:
                        break
                    last = scores[i]
                    near += [(-last, x) for x in members[int(found[i])].as_py()[: top + 1] if x != key]
                near = sorted(near)[:top]
                out_q += [key] * len(near)
                out_v += [x for _, x in near]
                out_s += [float(-s) for s, _ in near]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def search_index(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20,
                 width: int = SEARCH_WIDTH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` largest inner products found for each usable query.

    A candidate with the query's own key is left out. Ties go to the smaller id. Fewer candidates give fewer rows; an
    empty index or no queries give none. Repeated queries count once.
    """
    asked = queries.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.size(vector).alias("dims"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["id"])
    shards = index.select("dims", "shard").distinct()
    # Query blocks: each meets every shard once.
    blocks = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    sent = (asked.join(blocks, "dims").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
            .join(shards.groupBy("dims").agg(F.collect_list("shard").alias("shards")), "dims")
            .select("dims", F.explode("shards").alias("shard"), "block", "id", "vector"))
    kept = index.join(blocks, "dims").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    on = ["dims", "shard", "block"]
    found = kept.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(_search(top, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20,
            width: int = SEARCH_WIDTH) -> DataFrame:
    """Index all ``vectors``, then search them for ``queries``."""
    spark = vectors.sparkSession
    path = work_path(spark, "graph")
    build_index(vectors, path, key, vector)
    return search_index(spark.read.schema(INDEX).parquet(path), queries, key, vector, top, width)
