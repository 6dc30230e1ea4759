"""Approximate nearest neighbours: a robust-pruned directed graph in every shard.

Vectors are dealt to shards by a hash of their id. In a shard, equal vectors are one node.
Nodes enter the graph in random batches: a beam search in the graph so far proposes
neighbours, relaxed distance pruning keeps a diverse few, and reverse edges are pruned the
same way. A query walks each shard's graph with a beam and the shards' results are merged.

A shard has at most about `shard_rows` vectors, so tasks stay small whatever the table's
size; the built graphs are a written table, read again by every block of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridecast.llm.scratch import written

DEGREE, BEAM, RELAX = 32, 64, 1.2
SHARD_ROWS, QUERY_BLOCK = 8192, 20_000
BATCH = 256

INDEX_SCHEMA = "dim int, shard int, node int, vector array<double>, neighbours array<int>, vec_ids array<long>"


def _distances(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of points[ids] (rows, k) to one vector a row; infinite where id is -1."""
    apart = points[ids] - to[:, None, :]
    found = np.einsum("bkd,bkd->bk", apart, apart)
    found[ids < 0] = np.inf
    return found


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of `to` the `beam` nearest nodes met, nearest first: (ids, squared distances).

    All searches of the batch move together; places without a node are -1.
    """
    rows = np.arange(len(to))
    seen = np.zeros((len(to), len(points)), bool)
    seen[:, start] = True
    ids = np.full((len(to), beam), -1, np.int32)
    ids[:, 0] = start
    near = np.full((len(to), beam), np.inf)
    near[:, 0] = _distances(points, ids[:, :1], to)[:, 0]
    done = ids < 0
    while True:
        waiting = ~done
        active = rows[waiting.any(1)]
        if not len(active):
            return ids, near
        at = waiting[active].argmax(1)  # the beam is sorted: the first is the nearest
        done[active, at] = True
        fresh = graph[ids[active, at]].copy()
        known = (fresh < 0) | seen[active[:, None], fresh]
        fresh[known] = -1
        r, c = np.nonzero(~known)
        seen[active[r], fresh[r, c]] = True
        all_ids = np.concatenate([ids[active], fresh], 1)
        all_near = np.concatenate([near[active], _distances(points, fresh, to[active])], 1)
        all_done = np.concatenate([done[active], known], 1)
        order = np.argsort(all_near, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        near[active] = np.take_along_axis(all_near, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most `degree` neighbours a row: the nearest candidate, then the nearest that is not
    `relax` times closer to one already kept, and so on. Candidates are -1 where absent."""
    candidates = np.where(candidates == owners[:, None], -1, candidates)
    near = _distances(points, candidates, points[owners])
    order = np.argsort(near, 1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    repeated = np.zeros(candidates.shape, bool)  # equal ids have equal distances but may be apart in a tie
    by_id = np.argsort(candidates, 1, kind="stable")
    sorted_ids = np.take_along_axis(candidates, by_id, 1)
    np.put_along_axis(repeated, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    alive = (candidates >= 0) & ~repeated
    kept = np.full((len(owners), degree), -1, np.int32)
    rows = np.arange(len(owners))
    vectors = points[candidates]
    for place in range(degree):
        left = alive.any(1)
        if not left.any():
            break
        at = alive.argmax(1)
        kept[:, place] = np.where(left, candidates[rows, at], -1)
        apart = vectors - vectors[rows, at][:, None, :]
        between = np.einsum("bkd,bkd->bk", apart, apart)
        alive &= relax * relax * between > near
        alive[rows, at] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours by node, -1 where absent; the node where searches start)."""
    n = len(points)
    middle = points.mean(0)
    start = int(((points - middle) ** 2).sum(1).argmin())
    slack = degree + degree // 2  # reverse edges gather up to here before a node is pruned again
    graph = np.full((n, slack), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([[np.int32(start)], order[order != start]]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, max(1, at))]  # no batch is larger than the graph so far
        at += len(batch)
        found, _ = beam_search(points, graph, start, points[batch], beam)
        graph[batch, :degree] = robust_prune(points, batch, found, degree, relax)
        sources, places = np.nonzero(graph[batch] >= 0)
        targets, sources = graph[batch][sources, places], batch[sources]
        by_target = np.argsort(targets, kind="stable")
        targets, sources = targets[by_target], sources[by_target]
        nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
        incoming = np.full((len(nodes), int(count.max())), -1, np.int32)
        owner = np.repeat(np.arange(len(nodes)), count)
        incoming[owner, np.arange(len(targets)) - np.repeat(first, count)] = sources
        pool = np.concatenate([graph[nodes], incoming], 1)
        free = (pool >= 0).sum(1) <= slack
        if free.any():  # all fit: move the absent places to the end
            packed = np.argsort(pool[free] < 0, 1, kind="stable")[:, :slack]
            graph[nodes[free]] = np.take_along_axis(pool[free], packed, 1)
        full = np.flatnonzero(~free)
        for part in range(0, len(full), BATCH):
            some = full[part : part + BATCH]
            graph[nodes[some]] = -1
            graph[nodes[some], :degree] = robust_prune(points, nodes[some], pool[some], degree, relax)
    return graph, start


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zero."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(value, lambda x: x != 0.0), F.lit(False))


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column).cast("array<double>")
    return df.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), F.size(vector).alias("dim")
    )


def build_index(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BEAM,
    relax: float = RELAX,
) -> DataFrame:
    """The graph of every shard as a written table, a row for each distinct vector of a shard.

    Every usable vector is indexed (see `usable`); vectors of another length are in shards of
    their own and never compared. Equal vectors are one node with all their ids, so a vector
    repeated any number of times is spread over the shards and costs one node in each.
    """
    rows = _vectors(vectors, id_column, vector_column)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        points, node_of = np.unique(np.stack(frame["vector"].to_numpy()), axis=0, return_inverse=True)
        node_of = node_of.reshape(-1)
        ids = frame["vec_id"].to_numpy()
        order = np.lexsort((ids, node_of))
        members = np.split(ids[order], np.cumsum(np.bincount(node_of, minlength=len(points)))[:-1])
        graph, start = build_graph(points, degree, beam, relax)
        turn = np.concatenate([[start], np.delete(np.arange(len(points)), start)])  # searches start at node 0
        renamed = np.empty(len(points), np.int32)
        renamed[turn] = np.arange(len(points), dtype=np.int32)
        return pd.DataFrame(
            {
                "dim": np.int32(key[0]),
                "shard": np.int32(key[1]),
                "node": np.arange(len(points), dtype=np.int32),
                "vector": list(points[turn]),
                "neighbours": [renamed[row[row >= 0]] for row in graph[turn]],
                "vec_ids": [members[i] for i in turn],
            }
        )

    return written(rows.groupBy("dim", "shard").applyInPandas(build, INDEX_SCHEMA), "graph")


def search_index(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    beam: int = 2 * BEAM,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score (Euclidean distance).

    The query's own id is no candidate. Ties go to the smaller id. A query with fewer
    candidates gets them all; a query vector that is not usable gets none. Queries are a
    stated set; each block of them meets each shard once.
    """
    asked = _vectors(queries, id_column, vector_column).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("to_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard")).distinct()
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(shards, F.col("dim") == F.col("to_dim"))  # each query once for each shard of its length

    def search(graphs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(graphs) or not len(wanted):
            return empty
        graphs = graphs.sort_values("node")
        points = np.stack(graphs["vector"].to_numpy())
        near = graphs["neighbours"].to_list()
        graph = np.full((len(points), max(1, max(map(len, near)))), -1, np.int32)
        for node, ids in enumerate(near):
            graph[node, : len(ids)] = ids
        members = graphs["vec_ids"].to_list()
        out: list[tuple[int, int, float]] = []
        for first in range(0, len(wanted), BATCH):
            part = wanted.iloc[first : first + BATCH]
            to = np.stack(part["vector"].to_numpy())
            nodes, squares = beam_search(points, graph, 0, to, max(beam, k + 1))
            for query, row, distances in zip(part["query_id"], nodes, np.sqrt(squares), strict=True):
                found: list[tuple[float, int]] = []
                for node, distance in zip(row, distances, strict=True):
                    if node < 0 or (len(found) >= k and distance > found[k - 1][0]):
                        break
                    # Ids of a node are ascending, and one of them may be the query's own.
                    found += [(float(distance), int(i)) for i in members[node][: k + 1] if i != query]
                    found.sort()
                out += [(query, i, distance) for distance, i in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    found = (
        left.groupBy("dim", "shard", "block")
        .cogroup(right.groupBy("to_dim", "to_shard", "to_block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
