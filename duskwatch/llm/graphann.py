"""Nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one node. Nodes are dealt into shards of bounded size by a hash. Within a
shard a graph is built in rounds: every node searches the graph so far for itself, the
nodes met are pruned to a diverse few (a candidate goes if a chosen neighbour is closer to
it, by a factor, than the node is), and edges are mirrored and pruned again. Queries walk the graph
with a beam, many at a time, and what a shard finds is merged with the other shards' finds by
partial ranking.

Largest inner product becomes least distance by one more coordinate, the square root of what a vector's
squared length lacks to the shard's largest. Scores are inner products of the original vectors in
double precision.

Every vector is indexed. The query set is blocked: each shard meets each block of queries once,
so no task holds all queries, and a shard's graph is built once and stored.

Results for odd input: vectors that are null, empty, zero, of other length than most or with components that are null or not finite take no part; a
query with fewer than k candidates gets all; ties go to the smaller id; repeated rows (same id) count once, with the
least of their vectors; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm import store

#: Nodes in a shard, neighbours of a node, beam widths, and how much farther a pruned candidate may be.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX = 8192, 32, 64, 128, 1.2
#: Queries that a shard meets at a time.
QUERIES = 1024


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the coordinate that makes nearness by inner product one of distance."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(0, largest - (x * x).sum(1)))
    return np.concatenate((x, rest[:, None]), 1).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int):
    """The ``beam`` nearest nodes met from ``start``, per query: numbers and squared distances, nearest first (-1: none)."""
    n, m = len(points), len(queries)
    norms = (points * points).sum(1)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)

    def push(rows: np.ndarray, found: np.ndarray) -> None:
        fresh = (found >= 0) & ~seen[rows[:, None], np.maximum(found, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], found[r, c]] = True
        d = np.full(found.shape, np.inf, np.float32)
        f = found[r, c]
        d[r, c] = norms[f] - 2 * np.einsum("ij,ij->i", points[f], queries[rows[r]])
        # a node may stand twice in one list
        all_ids = np.concatenate((ids[rows], np.where(fresh, found, -1)), 1)
        all_dist = np.concatenate((dist[rows], d), 1)
        all_done = np.concatenate((done[rows], ~fresh), 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_dist, best, 1), axis=1, kind="stable"), 1)
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))

    push(np.arange(m), np.broadcast_to(start, (m, len(start))).copy())
    while True:
        open_ = ~done & (ids >= 0)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        # each query opens its nearest few
        order = np.argsort(~open_[rows], axis=1, kind="stable")[:, :4]
        pick = np.take_along_axis(ids[rows], order, 1)
        live = np.take_along_axis(open_[rows], order, 1)
        done[rows[:, None], order] = True
        near = np.where(live[:, :, None], graph[np.maximum(pick, 0)], -1).reshape(len(rows), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        push(rows, near)
    return ids, dist + (queries * queries).sum(1)[:, None]


def prune(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours of each node out of those found (-1: none), nearest first."""
    found = np.sort(np.where(found == nodes[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    cand = points[np.maximum(found, 0)]
    d = ((cand - points[nodes][:, None, :]) ** 2).sum(2)
    d[found < 0] = np.inf
    sq = (cand * cand).sum(2)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for j in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, j] = found[rows, best][ok]
        chosen = cand[rows, best]
        between = sq + sq[rows, best][:, None] - 2 * np.einsum("icd,id->ic", cand, chosen)
        d[relax * relax * between <= d] = np.inf
        d[rows, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 0):
    """Neighbour lists (-1: none) and entry nodes."""
    n = len(points)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, min(degree, max(1, n - 1))))
    if graph.shape[1] < degree:
        graph = np.concatenate((graph, np.full((n, degree - graph.shape[1]), -1)), 1)
    middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    start = np.unique(np.concatenate(([middle], rng.integers(0, n, min(n, 7)))))
    for factor in (1.0, relax):
        for batch in np.array_split(rng.permutation(n), -(-n // 512)):
            found, _ = beam_search(points, graph, start, points[batch], beam)
            graph[batch] = prune(points, batch, np.concatenate((found, graph[batch]), 1), degree, factor)
            # mirror the edges
            src = np.repeat(batch, degree)
            dst = graph[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            for a in range(0, len(nodes), 512):
                b = min(a + 512, len(nodes))
                extra = np.full((b - a, int(count[a:b].max())), -1, np.int64)
                for i in range(a, b):
                    extra[i - a, : count[i]] = src[first[i] : first[i] + count[i]]
                graph[nodes[a:b]] = prune(points, nodes[a:b], np.concatenate((graph[nodes[a:b]], extra), 1), degree, factor)
    return graph, start


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    x = _matrix(rows["vector"])
    largest = float((x * x).sum(1).max())
    graph, start = build(lift(x, largest))
    return pd.DataFrame(
        [(int(rows["shard"].iloc[0]), rows["node"].to_numpy(np.int64).tobytes(), x.tobytes(), graph.astype(np.int32).tobytes(), start.astype(np.int32).tobytes(), largest)],
        columns=["shard", "nodes", "vectors", "graph", "start", "largest"],
    )


def _search(k: int, beam: int, need: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "node", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        row = index.iloc[0]
        nodes = np.frombuffer(row["nodes"], np.int64)
        x = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), -1)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(nodes), -1).astype(np.int64)
        start = np.frombuffer(row["start"], np.int32).astype(np.int64)
        points = lift(x, row["largest"])
        out = []
        for a in range(0, len(queries), 256):
            q = _matrix(queries["vector"].iloc[a : a + 256])
            found, _ = beam_search(points, graph, start, np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32), max(beam, need))
            score = np.einsum("icd,id->ic", x[np.maximum(found, 0)], q)
            score[found < 0] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :need]
            s = np.take_along_axis(score, best, 1)
            got = nodes[np.maximum(np.take_along_axis(found, best, 1), 0)]
            ids = np.repeat(queries["query_id"].to_numpy(np.int64)[a : a + 256], best.shape[1]).reshape(s.shape)
            ok = np.isfinite(s)
            out.append(pd.DataFrame({"query_id": ids[ok], "node": got[ok], "score": s[ok]}, columns=columns))
        return pd.concat(out)

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest found for each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``."""
    x = F.col("vector")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    good = store.keep(good.groupBy("vec_id").agg(F.min("vector").alias("vector")), "ann-vectors").df
    length = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if length is None:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("vector") == length["size"])
    node = good.groupBy("vector").agg(F.min("vec_id").alias("node"))
    node = store.keep(node, "ann-nodes").df
    shards = -(-node.count() // shard_rows)
    placed = node.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    kind = "shard int, nodes binary, vectors binary, graph binary, start binary, largest double"
    index = store.keep(placed.groupBy("shard").applyInPandas(_build, kind), "ann-index").df
    # queries with equal vectors are one; a query's own id is left out at the end
    asked = good.where(F.col("vec_id") % every == 0).join(node, "vector").select("vec_id", "node")
    asked = store.keep(asked, "ann-asked").df
    points = node.join(asked.select("node").distinct(), "node").select(F.col("node").alias("query_id"), "vector")
    blocks = max(1, -(-points.count() // QUERIES))
    # in each shard, every block of queries is a group
    group = [F.col("shard"), F.col("block")]
    met = points.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<int>")))
    found = held.groupBy(*group).cogroup(met.groupBy(*group)).applyInPandas(_search(k, beam, k + 1), "query_id long, node long, score double")
    # k + 1 nodes are enough for k results beside the query's own id
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).drop("_r")
    # of a node's ids only the smallest k + 1 can be among the results; a hot node's ids are ranked in parts first
    named = good.join(node, "vector").select("node", "vec_id").withColumn("_salt", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(64)))
    small = named.withColumn("_r", F.row_number().over(Window.partitionBy("node", "_salt").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    small = small.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    hits = found.join(small.select("node", "vec_id"), "node").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    hits = hits.where(F.col("_r") <= k + 1).select(F.col("query_id").alias("node"), "vec_id", "score", "_r")
    each = asked.select(F.col("vec_id").alias("query_id"), "node").join(hits, "node").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
