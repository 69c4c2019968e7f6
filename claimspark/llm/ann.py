"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by hash. In a shard, greedy beam searches from a central vector propose neighbours of
each vector; relaxed distance pruning (``alpha``) keeps diverse edges, ``degree`` at most; reverse edges are pruned the
same way. Nodes that no path leads to then are linked to the nearest in reach that has a place left, and compared outright, as
one such link seldom is the way of a greedy search. Queries are beam-searched in every shard, in blocks of
``block_queries`` that an index travels to, and the best of all shards stay, the distances of all that a search met
measured anew in double precision.

Equal vectors are one node with their smallest ids, k + 1 of them: no other id can be among the k nearest, as ties go
to the smaller. Vectors that are null, empty or zero, or hold null or non-finite components take no part, as rows or as
queries; vectors of different lengths stand in different shards; null ids take no part; repeated rows of an id count
once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import parts_for, stage, table


def _near(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes."""
    return np.maximum(norms[ids] - 2 * np.einsum("bnd,bd->bn", x[ids], q) + (q * q).sum(1)[:, None], 0)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(node, squared distance) of the ``beam`` nearest met by each query, nearest first; -1 where there are fewer."""
    n, b = len(x), len(q)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, _near(x, norms, q, np.full((b, 1), entry))[:, 0], False
    seen[:, entry] = seen[:, n] = True
    while True:
        open_ = np.where(done, np.inf, dist)
        pick = np.argsort(open_, axis=1)[:, :width]
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not live.any():
            return ids, dist
        np.put_along_axis(done, pick, True, 1)
        nodes = np.where(live, np.take_along_axis(ids, pick, 1), n)
        new = np.sort(graph[nodes].reshape(b, -1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[rows, new]] = n
        seen[rows, new] = True
        fresh = new < n
        d = np.where(fresh, _near(x, norms, q, np.minimum(new, n - 1)), np.inf).astype(np.float32)
        all_d = np.concatenate([dist, d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist = np.take_along_axis(all_d, best, 1)
        ids = np.take_along_axis(np.concatenate([ids, np.where(fresh, new, -1)], axis=1), best, 1)
        done = np.take_along_axis(np.concatenate([done, ~fresh], axis=1), best, 1) | (ids < 0)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """[point, degree] neighbours out of ``cand`` (-1: none): the nearest, then the nearest not covered, and so on. A
    candidate is covered by a neighbour that is ``alpha`` times nearer to it than the point is. n: no neighbour."""
    n, b = len(x), len(points)
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == points[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    v = x[np.maximum(cand, 0)]
    d = np.where(bad, np.inf, ((v - x[points][:, None]) ** 2).sum(2))
    order = np.argsort(d, axis=1)
    d, cand, v = np.take_along_axis(d, order, 1), np.take_along_axis(cand, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    norm = (v * v).sum(2)
    pair = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    alive, rows = np.isfinite(d), np.arange(b)
    out = np.full((b, degree), n, dtype=np.int64)
    for j in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, j] = cand[rows, at][some]
        alive &= alpha * alpha * pair[rows, at] > d
        alive[rows, at] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 6, batch: int = 512) -> tuple[np.ndarray, int]:
    """(graph [n + 1, degree], entry) over the rows of x; unused places hold n, and so does row n."""
    graph, entry = grow_graph(x, degree, beam, alpha, seed, batch)
    link_strays(x, graph, entry)
    return graph, entry


def grow_graph(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 6, batch: int = 512) -> tuple[np.ndarray, int]:
    """As ``build_graph``, but pruning may leave nodes that no path leads to."""
    n = len(x)
    norms = (x * x).sum(1)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n + 1, degree), n, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    at, size = 0, 1
    while at < n:  # batches double up to ``batch``, so early ones meet a grown graph
        points = order[at : at + size]
        at, size = at + size, min(2 * size, batch)
        found, _ = beam_search(x, norms, graph, entry, x[points], beam)
        graph[points] = robust_prune(x, points, np.concatenate([found, np.where(graph[points] < n, graph[points], -1)], axis=1), degree, alpha)
        src, dst = np.repeat(points, degree), graph[points].ravel()
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        while len(dst):  # all proposals of a node, ``2 * degree`` at a time
            to, first, many = np.unique(dst, return_index=True, return_counts=True)
            rank = np.arange(len(dst)) - np.repeat(first, many)
            now = rank < 2 * degree
            _add_edges(x, graph, to, src[now], dst[now], degree, alpha)
            src, dst = src[~now], dst[~now]
    return graph, entry


def _add_edges(x: np.ndarray, graph: np.ndarray, to: np.ndarray, src: np.ndarray, dst: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from each of ``to`` (those of sorted ``dst``) to its ``src``, pruned where there are too many."""
    n = len(x)
    first, end = np.searchsorted(dst, to), np.searchsorted(dst, to, side="right")
    for part in range(0, len(to), 2048):
        t, f, m = to[part : part + 2048], first[part : part + 2048], (end - first)[part : part + 2048]
        more = np.full((len(t), int(m.max())), -1, dtype=np.int64)
        fill = np.arange(more.shape[1]) < m[:, None]
        more[fill] = src[(f[:, None] + np.arange(more.shape[1]))[fill]]
        both = np.concatenate([np.where(graph[t] < n, graph[t], -1), more], axis=1)
        free = (both >= 0).sum(1) <= degree
        packed = -np.sort(-both[free], axis=1)[:, :degree]
        packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
        graph[t[free]] = np.where(packed < 0, n, packed)
        if (~free).any():
            graph[t[~free]] = robust_prune(x, t[~free], both[~free], degree, alpha)


def strays(graph: np.ndarray, entry: int) -> np.ndarray:
    """The nodes that no path leads to from the entry."""
    n = len(graph) - 1
    met = np.zeros(n + 1, dtype=bool)
    met[n] = met[entry] = True
    edge = np.array([entry])
    while len(edge):
        edge = np.unique(graph[edge])
        edge = edge[~met[edge]]
        met[edge] = True
    return np.nonzero(~met)[0]


def link_strays(x: np.ndarray, graph: np.ndarray, entry: int) -> None:
    """Edges to the nodes that no path leads to, each from the nearest node in reach that has places left, the nearest first, until all
    are in reach or no place is left. Pruning may take a node's last way in; no edge is taken away here."""
    n = len(x)
    norms = (x * x).sum(1)
    while len(lost := strays(graph, entry)):
        met = np.ones(n, dtype=bool)
        met[lost] = False
        free = np.where(met, (graph[:n] == n).sum(axis=1), 0)
        room = np.nonzero(free)[0]
        if not len(room):
            return
        src, far = np.zeros(len(lost), dtype=np.int64), np.zeros(len(lost), dtype=x.dtype)
        for part in range(0, len(lost), 1024):
            d = norms[room] - 2 * x[lost[part : part + 1024]] @ x[room].T
            src[part : part + 1024], far[part : part + 1024] = room[d.argmin(axis=1)], d.min(axis=1) + norms[lost[part : part + 1024]]
        by = np.lexsort((far, src))
        src, dst = src[by], lost[by]
        _, first, many = np.unique(src, return_index=True, return_counts=True)
        rank = np.arange(len(src)) - np.repeat(first, many)
        now = rank < free[src]
        src, dst, rank = src[now], dst[now], rank[now]
        place = np.argsort(graph[src] != n, axis=1, kind="stable")[np.arange(len(src)), rank]
        graph[src, place] = dst


def usable(v) -> F.Column:
    """True of a vector that takes part."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda e: e != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = 4000, degree: int = 32, beam: int = 96, alpha: float = 1.2, block_queries: int = 8192, at_once: int = 512) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row of ``queries``, but for itself."""
    v, q = ((d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).dropDuplicates(["id", "v"])) for d in (vectors, queries))
    ranked = v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = stage(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    shards = parts_for(nodes, shard_vectors)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(key=[ids[0] for ids in rows["ids"]]).sort_values("key", ignore_index=True)
        exact = np.stack(rows["v"].to_numpy()).astype("<f8")
        x = exact.astype(np.float32)
        graph, entry = grow_graph(x, degree, max(beam * 2 // 3, degree), alpha)
        lost = strays(graph, entry)
        link_strays(x, graph, entry)
        ids = np.concatenate(rows["ids"].to_numpy()).astype("<i8")
        many = rows["ids"].map(len).to_numpy().astype("<i4")
        return pd.DataFrame({"dim": [int(rows["dim"].iloc[0])], "n": [len(x)], "entry": [entry], "v": [exact.tobytes()], "graph": [graph.astype("<i4").tobytes()], "lost": [lost.astype("<i4").tobytes()], "ids": [ids.tobytes()], "many": [many.tobytes()]})

    index = stage(dealt.groupBy("shard", "dim").applyInPandas(build, "dim int, n int, entry int, v binary, graph binary, lost binary, ids binary, many binary"), "graphs")
    asked = stage(q.withColumn("dim", F.size("v")), "queries")
    blocks = parts_for(asked, block_queries)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qd": [int(rows["dim"].iloc[0])], "b": [int(rows["b"].iloc[0])], "qids": [rows["id"].to_numpy().astype("<i8").tobytes()], "qv": [np.stack(rows["v"].to_numpy()).astype("<f8").tobytes()]})

    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("b", "dim").applyInPandas(gather, "qd int, b int, qids binary, qv binary")
    work = index.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "b").where("qd = dim").repartition(4 * max(shards * blocks // 4, 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                exact = np.frombuffer(r.v, "<f8").reshape(r.n, r.dim)
                x = exact.astype(np.float32)
                qids, qvs = np.frombuffer(r.qids, "<i8"), np.frombuffer(r.qv, "<f8").reshape(-1, r.dim)
                many = np.frombuffer(r.many, "<i4").astype(np.int64)
                ids, first = np.frombuffer(r.ids, "<i8"), np.cumsum(many) - many
                graph = np.frombuffer(r.graph, "<i4").reshape(r.n + 1, -1).astype(np.int64)
                norms, lost = (x * x).sum(1), np.frombuffer(r.lost, "<i4")  # linked or not
                for part in range(0, len(qids), at_once):
                    qid, qv = qids[part : part + at_once], qvs[part : part + at_once]
                    found, _ = beam_search(x, norms, graph, r.entry, qv.astype(np.float32), beam)
                    met = np.sort(np.concatenate([found, np.broadcast_to(lost, (len(found), len(lost)))], axis=1), axis=1)
                    found = np.where(np.diff(met, axis=1, prepend=-1) > 0, met, -1)
                    score = np.sqrt(((exact[np.maximum(found, 0)] - qv[:, None]) ** 2).sum(2))
                    of, node = np.nonzero(found >= 0)[0], found[found >= 0]
                    times = many[node]
                    vec = ids[np.repeat(first[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                    out = pd.DataFrame({"query_id": np.repeat(qid[of], times), "vec_id": vec, "score": np.repeat(score[found >= 0], times)})
                    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"])
                    yield out.groupby("query_id", sort=False).head(k)

    hits = work.mapInPandas(search, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE: dict[str, str] = {}
