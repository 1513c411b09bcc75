"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard.

Equal vectors are one node, which keeps the smallest ids it can ever need.  Nodes
are hashed to as many shards as the cluster has cores, within LEAST_NODES and MOST_NUMBERS (components) a shard: a search takes little
longer in a larger graph, so work grows with queries times shards, and shards grow with the table first, their number only then.  A shard's graph is built in one task:
greedy searches from entry points propose neighbours, and robust pruning keeps
the nearest candidate and drops those that it is nearer to by the factor ALPHA,
so edges stay short and diverse.  A beam search runs the queries, dealt to blocks so that there are tasks for all cores, on
each shard's graph, and the shards' best are merged.  A task reads its graph once, and its block of queries streams past it.

The graph is built for Euclidean distance after the usual extra component
``sqrt(M**2 - |x|**2)``, under which the nearest node of a query has the largest
inner product.  Scores are inner products of the original vectors in double
precision.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; only vectors of the same length are compared; repeated
rows of an id and vector are one; ties go to the smaller id; fewer candidates
than asked for give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import batched, settled, table

NEAREST = 20
LEAST_NODES, MOST_NUMBERS = 4096, 1 << 23
#: Queries searched at once, and the bits of what they have seen.
QUERY_BLOCK, SEEN_BITS = 512, 1 << 25
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 96, 1.2
BATCH = 256


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision, all divided by one number, so that none is too large: the order of inner products stays."""
    return (x / np.abs(x).max()).astype(np.float32)


def search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best nodes that a beam search finds and their inner products (single precision), best first; -1 where fewer."""
    n, count = len(x), len(queries)
    rows = np.arange(count)[:, None]
    start = np.broadcast_to(entries[:beam], (count, len(entries[:beam])))
    score = queries @ x[entries[:beam]].T
    width = beam + edges.shape[1]
    ids, gain = np.full((count, width), -1, np.int32), np.full((count, width), -np.inf, np.float32)
    ids[:, : start.shape[1]], gain[:, : start.shape[1]] = start, score
    done = np.ones((count, width), bool)
    done[:, : start.shape[1]] = False
    seen = np.zeros((count, n + 1), bool)
    seen[:, entries[:beam]] = True
    seen[:, n] = True  # where an edge is missing
    while True:
        open_gain = np.where(done[:, :beam], -np.inf, gain[:, :beam])
        best = open_gain.argmax(1)
        live = np.flatnonzero(open_gain[rows[:, 0], best] > -np.inf)
        if not len(live):
            break
        at = best[live]
        done[live, at] = True
        near = edges[ids[live, at]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        found = np.einsum("bd,brd->br", queries[live], x[np.minimum(near, n - 1)])
        ids[live, beam:], gain[live, beam:], done[live, beam:] = near, np.where(new, found, -np.inf), ~new
        order = np.argpartition(-gain[live], beam - 1, axis=1)
        line = live[:, None]
        ids[live], gain[live], done[live] = ids[line, order], gain[line, order], done[line, order]
        gain[live, beam:] = -np.inf
    order = np.argsort(-gain[:, :beam], axis=1, kind="stable")
    gain = gain[rows, order]
    return np.where(gain > -np.inf, ids[rows, order], -1), gain


def pruned(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of each point's candidates (-1 or the point itself: none): at most degree neighbours, n where fewer."""
    n = len(x)
    valid = (candidates >= 0) & (candidates < n) & (candidates != points[:, None])
    c = np.where(valid, candidates, 0)
    vectors = x[c]
    far = ((vectors - x[points][:, None, :]) ** 2).sum(2)
    far[~valid] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    rows = np.arange(len(points))[:, None]
    c, far, vectors = c[rows, order], far[rows, order], vectors[rows, order]
    same = np.zeros_like(far, bool)
    same[:, 1:] = (c[:, 1:] == c[:, :-1]) & (far[:, 1:] == far[:, :-1])
    far[same] = np.inf
    square = (vectors**2).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    left = np.isfinite(far)
    out = np.full((len(points), degree), n, np.int32)
    for k in range(degree):
        pick = left.argmax(1)
        has = left[rows[:, 0], pick]
        if not has.any():
            break
        out[:, k] = np.where(has, c[rows[:, 0], pick], n)
        left &= ALPHA * ALPHA * between[rows[:, 0], pick] > far
        left[rows[:, 0], pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of the graph over the rows of vectors; node n stands for a missing edge."""
    n = len(vectors)
    x = scaled(vectors)
    square = (x * x).sum(1)
    x = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1)
    edges = np.full((n + 1, degree), n, np.int32)
    draw = np.random.default_rng(n)
    entries = draw.permutation(n)[: max(8, beam // 4)] if n > beam else np.arange(n)
    if n <= degree + 1:
        for i in range(n):
            others = np.delete(np.arange(n), i)
            edges[i, : len(others)] = others
        return edges, entries
    # The search key is the node itself: nearest under Euclidean distance is largest x.y - |y|^2 / 2.
    lifted = np.concatenate([x, -0.5 * (x * x).sum(1, keepdims=True)], 1)
    order = draw.permutation(n)
    for passes in range(2):
        at, size = 0, 1
        while at < n:
            batch = order[at : at + size]
            key = np.concatenate([x[batch], np.ones((len(batch), 1), np.float32)], 1)
            found, _ = search(lifted, edges, entries, key, beam)
            candidates = np.concatenate([found, np.where(edges[batch] < n, edges[batch], -1)], 1)
            edges[batch] = pruned(x, batch, candidates, degree)
            # Edges back.
            source, target = np.repeat(batch, degree), edges[batch].ravel()
            keep = target < n
            source, target = source[keep], target[keep]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(nodes), min(int(counts.max()), 2 * degree)), -1, np.int64)
            place = np.arange(len(target)) - np.repeat(first, counts)
            fits = place < extra.shape[1]
            extra[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = source[fits]
            old = np.where(edges[nodes] < n, edges[nodes], -1)
            for a in range(0, len(nodes), 512):
                k = slice(a, a + 512)
                edges[nodes[k]] = pruned(x, nodes[k], np.concatenate([old[k], extra[k]], 1), degree)
            at += size
            size = min(BATCH, size * 2) if passes == 0 else BATCH
    return edges, entries


INDEX = "dim int, shard long, nodes long, vectors binary, edges binary, entries binary, owners binary, ids binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the rows that take part."""
    e = F.col("embedding")
    good = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.size(e).alias("dim")).where("vec_id is not null")


def index(vectors: DataFrame, keep: int = NEAREST + 1) -> tuple[DataFrame, int]:
    """One row a shard (INDEX), in a table of its own; the number of shards. keep: of equal vectors the smallest ids kept, all that a search for keep - 1 can return."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    members = usable(vectors).distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= keep)
    nodes = settled(members.groupBy("embedding", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = shards_of(*nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first(), vectors.sparkSession.sparkContext.defaultParallelism)
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[i[0] for i in rows["ids"]]).sort_values("first")
        x = np.stack(rows["embedding"].to_list()).astype("<f8")
        edges, entries = build(x)
        owners = np.repeat(np.arange(len(x)), [len(i) for i in rows["ids"]]).astype("<i4")
        ids = np.concatenate(rows["ids"].to_list()).astype("<i8")
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "nodes": len(x), "vectors": x.tobytes(), "edges": edges.astype("<i4").tobytes(), "entries": entries.astype("<i4").tobytes(), "owners": owners.tobytes(), "ids": ids.tobytes()}])

    return settled(nodes.groupBy("dim", "shard").applyInPandas(run, INDEX), "graphs"), shards


def shards_of(nodes: int, dim: int, cores: int) -> int:
    """As many shards as cores, of LEAST_NODES nodes at least; more where a shard would hold more than MOST_NUMBERS numbers."""
    return max(1, min(cores, -(-nodes // LEAST_NODES)), -(-nodes * dim // MOST_NUMBERS))


def nearest(queries: DataFrame, graphs: DataFrame, shards: int, count: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the count nearest found of each usable row of queries (vec_id, embedding), without the row of its own id."""
    asked = usable(queries).distinct()
    blocks = max(1, min(-(-asked.count() // QUERY_BLOCK), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // shards)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", every(shards))
    parts = graphs.withColumn("block", every(blocks))
    # A graph's row comes before the queries of its shard and block.
    both = parts.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    keys = ("dim", "shard", "block")
    both = both.repartition(*keys).sortWithinPartitions(*keys, "kind").select(*GRAPH, "dim", "shard", "block", "kind", "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, of = None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            place = [batch.column(c).to_pylist() for c in keys]
            bounds = [0, *(np.flatnonzero(kinds == 0)).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):  # noqa: B905
                if a == b:
                    continue
                if kinds[a] == 0:
                    graph, of, a = Graph(*(batch.column(c)[a].as_py() for c in GRAPH), place[0][a]), tuple(p[a] for p in place), a + 1
                # Queries whose shard has no vectors of their length have no graph before them.
                mine = [k for k in range(a, b) if of == tuple(p[k] for p in place)]
                if mine and graph is not None:
                    part = batch.take(pa.array(mine))
                    q = np.array(part.column("embedding").to_pylist(), np.float64)
                    yield from graph.found(part.column("vec_id").to_numpy(), q, count)

    found = batched(both, run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


GRAPH = ("nodes", "vectors", "edges", "entries", "owners", "ids")


class Graph:
    """A shard's graph, and the ids of its nodes."""

    def __init__(self, nodes: int, vectors: bytes, edges: bytes, entries: bytes, owners: bytes, ids: bytes, dim: int):
        self.nodes, self.vectors = nodes, np.frombuffer(vectors, "<f8").reshape(nodes, dim)
        self.near, self.edges, self.entries = scaled(self.vectors), np.frombuffer(edges, "<i4").reshape(nodes + 1, -1), np.frombuffer(entries, "<i4")
        self.ids, self.first = np.frombuffer(ids, "<i8"), np.searchsorted(np.frombuffer(owners, "<i4"), np.arange(nodes + 1))

    def found(self, query_ids: np.ndarray, queries: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
        """FOUND for some queries: of each the count best, ties with the last one by id."""
        size = max(1, min(QUERY_BLOCK, SEEN_BITS // self.nodes))
        for a in range(0, len(queries), size):
            q = queries[a : a + size]
            nodes, _ = search(self.near, self.edges, self.entries, (q / np.abs(q).max(1, keepdims=True)).astype(np.float32), max(SEARCH_BEAM, count + 2))
            score = np.einsum("bd,brd->br", q, self.vectors[np.maximum(nodes, 0)])
            score[nodes < 0] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, : count + 1]
            line = np.arange(len(q))[:, None]
            # Ties with the last one stay: their ids decide.
            limit = score[line, top[:, -1:]]
            query, place = np.nonzero((score >= limit) & (nodes >= 0))
            node = nodes[query, place]
            sizes = self.first[node + 1] - self.first[node]
            at = np.repeat(self.first[node] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            rows = pd.DataFrame({"query_id": np.repeat(query_ids[a : a + size][query], sizes), "vec_id": self.ids[at], "score": np.repeat(score[query, place], sizes)})
            rows = rows[rows["query_id"] != rows["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            yield pa.RecordBatch.from_pandas(rows.groupby("query_id").head(count), preserve_index=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    graphs, shards = index(vectors)
    return nearest(vectors.where("vec_id % 20 = 0"), graphs, shards)
