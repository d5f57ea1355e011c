"""Embedding near-dedup over hierarchical navigable small-world graphs, one a shard (operator 4).

Equal vectors become one first, with their number. Vectors are dealt to shards by a hash of their id, as many as their
number asks for. A shard's vectors are inserted in batches in the order of their hashes: each descends greedily from
the top layer to its own (drawn by id, layer l with chance M**-l), searches its layers by beam, and links to what the
beam and its own batch hold nearest, spread by the usual diversity rule; lists that overflow are spread anew. Every
vector then queries every shard: greedy descent, then a beam over layer 0 whose width doubles until an audit against brute
force finds the nearest row of RECALL of the sampled queries that have one to link with. What the beam hits is widened to the hit's near-duplicate
cluster in its shard, so a large group of near copies is found whole, and all pairs are verified by cosine in double
precision. A task returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.llm.components import components, roots
from greenwake.session import cut, drop_cut, ship

M = 12
RECALL = 0.98
#: Queries of an audit's sample, samples at most, linked queries that are enough, and the narrowest beam.
AUDIT, ROUNDS, ENOUGH, LEAST = 512, 8, 64, 32
BLOCK = 512
#: Beam of an insertion.
INSERT = 48
#: Vectors of a shard, and queries that meet it in one task.
PER_SHARD, PER_TASK = 65_536, 32_768


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _spread(cand: np.ndarray, sim: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Up to keep of each row's candidates, one being taken if it's nearer the node than any taken before; -1 pads."""
    v = x[cand]
    among = np.einsum("bid,bjd->bij", v, v)
    taken = np.zeros(cand.shape, dtype=bool)
    for j in range(cand.shape[1]):
        blocked = (taken & (among[:, j, :] > sim[:, j, None])).any(axis=1)
        taken[:, j] = ~blocked & (sim[:, j] > -1.5) & (taken.sum(axis=1) < keep)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :keep]  # the taken ones first, then the rest by nearness
    return np.where(np.take_along_axis(sim, order, 1) > -1.5, np.take_along_axis(cand, order, 1), -1)


def _linked_back(table: np.ndarray, x: np.ndarray, dst: np.ndarray, src: np.ndarray, sim: np.ndarray) -> None:
    """Adds src to the links of dst in place; a list that overflows keeps a spread choice of its links."""
    width = table.shape[1]
    order = np.lexsort((-sim, dst))
    dst, src, sim = dst[order], src[order], sim[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    near = place < width  # what is further than a whole list's worth of new ones can't stay
    dst, src, sim, place = dst[near], src[near], sim[near], place[near]
    rows, own = np.unique(dst, return_inverse=True)
    for lo in range(0, len(rows), BLOCK):
        some = rows[lo : lo + BLOCK]
        mine = (own >= lo) & (own < lo + BLOCK)
        cand = np.full((len(some), 2 * width), -1, dtype=np.int64)
        cand[:, :width] = table[some]
        cand[own[mine] - lo, width + place[mine]] = src[mine]
        has = cand >= 0
        full = has.sum(axis=1) > width
        easy = np.argsort(~has, axis=1, kind="stable")[:, :width]
        table[some] = np.take_along_axis(cand, easy, 1)
        if full.any():
            c, ok = cand[full], has[full]
            s = np.where(ok, np.einsum("bkd,bd->bk", x[c], x[some[full]]), -2).astype(np.float32)
            best = np.argsort(-s, axis=1, kind="stable")[:, : width + width // 2]
            table[some[full]] = _spread(np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1), x, width)


def build(ids: np.ndarray, vectors: np.ndarray, cosine: float, m: int = M, weight: np.ndarray | None = None) -> dict:
    """The graph of a shard: vectors in the order of their hashes, layers from the top down, clusters of rows that
    insertion found near `cosine`, and how many equal vectors each stands for."""
    order = np.lexsort((ids, _mixed(ids)))
    ids, vectors = ids[order], vectors[order]
    weight = np.ones(len(ids), np.int64) if weight is None else weight[order]
    x, n = _unit(vectors), len(ids)
    level = np.floor(-np.log((_mixed(ids + 1) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / np.log(m)).astype(int)
    nodes = [np.flatnonzero(level >= lev) for lev in range(int(level.max(initial=0)) + 1)]
    tables = [np.full((len(some), 4 * m if lev == 0 else 2 * m), -1, dtype=np.int32) for lev, some in enumerate(nodes)]
    rows = [x if lev == 0 else x[some] for lev, some in enumerate(nodes)]
    root, at = np.arange(n), 0
    while at < n:
        end = min(n, at + min(BLOCK, max(16, at // 2)))
        q, start = x[at:end], None
        for lev in range(len(nodes) - 1, -1, -1):
            have, upto = np.searchsorted(nodes[lev], [at, end])
            found, sim = np.zeros((end - at, 0), np.int64), np.zeros((end - at, 0), np.float32)
            if have:
                begin = np.zeros((end - at, 1), np.int64) if start is None else np.where(start >= 0, np.searchsorted(nodes[lev], start), -1)
                found, sim = _beam(q, rows[lev][:have], tables[lev][:have], begin, INSERT if lev == 0 else 12)
                start = np.where(found >= 0, nodes[lev][np.maximum(found, 0)], -1)
            if upto == have:
                continue
            mine = nodes[lev][have:upto] - at  # the batch's rows of this layer
            among = q[mine] @ q[mine].T
            np.fill_diagonal(among, -2)
            cand = np.concatenate([found[mine], np.broadcast_to(np.arange(have, upto), among.shape)], axis=1)
            sims = np.concatenate([np.where(found[mine] >= 0, sim[mine], -2), among], axis=1)
            keep = 2 * m if lev == 0 else m
            if lev == 0:  # links found so far hang clusters together
                r, c = np.nonzero(sims >= cosine - 1e-4)
                root = roots(np.concatenate([r + at, np.arange(end)]), np.concatenate([cand[r, c], root[:end]]), n)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * keep]
            cand, sims = np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1)
            chosen = _spread(np.maximum(cand, 0), sims, rows[lev], keep)
            tables[lev][have:upto, : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            src, dst = have + r, chosen[r, c].astype(np.int64)
            new = dst < have
            _linked_back(tables[lev], rows[lev], dst[new], src[new], np.einsum("nd,nd->n", rows[lev][dst[new]], rows[lev][src[new]]))
        at = end
    layers = [(some.astype(np.int32), table) for some, table in zip(nodes, tables, strict=True)][::-1]
    return {"ids": ids, "vectors": vectors, "layers": layers, "cluster": root, "weight": weight}


def _beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's beam, -1 padded, most similar first; all queries step together."""
    b, n = len(q), len(x)
    width = min(width, n)
    seen = np.zeros((b, n), dtype=bool)
    rows = np.arange(b)[:, None]
    node = np.full((b, width), -1, dtype=np.int64)
    sim = np.full((b, width), -3, dtype=np.float32)
    done = np.ones((b, width), dtype=bool)
    k = min(start.shape[1], width)
    node[:, :k] = start[:, :k]
    sim[:, :k] = np.where(node[:, :k] >= 0, np.einsum("bkd,bd->bk", x[node[:, :k]], q), -3)
    done[:, :k] = node[:, :k] < 0
    seen[rows, np.maximum(node[:, :k], 0)] |= node[:, :k] >= 0
    live = np.arange(b)
    take = 3
    while len(live):
        order = np.argsort(np.where(done[live], 3, -sim[live]), axis=1, kind="stable")[:, :take]
        open_ = ~np.take_along_axis(done[live], order, 1)
        some = open_.any(axis=1)
        live, order, open_ = live[some], order[some], open_[some]
        if not len(live):
            break
        at = np.where(open_, np.take_along_axis(node[live], order, 1), -1)
        done[live[:, None], order] = True
        near = links[np.maximum(at, 0)].astype(np.int64)
        near[at < 0] = -1
        near = near.reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], np.maximum(near, 0)]] = -1
        r, c = np.nonzero(near >= 0)
        got = near[r, c]
        seen[live[r], got] = True
        s = np.full(near.shape, -3, dtype=np.float32)
        s[r, c] = np.einsum("nd,nd->n", x[got], q[live[r]])
        all_n, all_s = np.concatenate([node[live], near], axis=1), np.concatenate([sim[live], s], axis=1)
        all_d = np.concatenate([done[live], near < 0], axis=1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        node[live], sim[live], done[live] = np.take_along_axis(all_n, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_d, top, 1)
    return node, sim


def search(graph: dict, x: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's beam in the shard after descent from the top layer."""
    start = None
    for depth, (nodes, links) in enumerate(graph["layers"]):
        last = depth == len(graph["layers"]) - 1
        begin = np.zeros((len(q), 1), np.int64) if start is None else np.where(start >= 0, np.searchsorted(nodes, start), -1)
        node, sim = _beam(q, x[nodes], links, begin, width if last else max(4, width // 4))
        start = np.where(node >= 0, nodes[np.maximum(node, 0)], -1)
    return start, sim


def audited_width(graph: dict, x: np.ndarray, q: np.ndarray, ids: np.ndarray, cosine: float, recall: float = RECALL) -> int:
    """The beam width at which queries that have another row to link with find their nearest one as often as recall
    asks. Queries are sampled in the order of their hashes, AUDIT at a time, until ENOUGH such are met or ROUNDS samples
    are through; the fewer have a link, the fewer links there are to miss."""
    order, some, best, own = np.argsort(_mixed(ids), kind="stable"), [], [], []
    for at in range(0, min(len(order), AUDIT * ROUNDS), AUDIT):
        pick = order[at : at + AUDIT]
        top = np.where(ids[pick][:, None] == graph["ids"][None, :], -3, q[pick] @ x.T).max(axis=1)
        linked = top >= cosine
        some.append(q[pick][linked]), best.append(top[linked]), own.append(ids[pick][linked])
        if sum(map(len, best)) >= ENOUGH:
            break
    some, best, own = np.concatenate(some), np.concatenate(best), np.concatenate(own)
    width = LEAST
    while len(best) and width < len(x):
        node, sim = search(graph, x, some, width)
        found = np.where((node >= 0) & (graph["ids"][np.maximum(node, 0)] != own[:, None]), sim, -3).max(axis=1)
        if (found >= best - 1e-6).mean() >= recall:
            break
        width *= 2
    return width


def links(graph: dict, ids: np.ndarray, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) rows for queries against a shard: n links of vector a, which hangs together with b."""
    x, q = _unit(graph["vectors"]), _unit(vectors)
    norm_x, norm_q = _norm(graph["vectors"]), _norm(vectors)
    width = audited_width(graph, x, q, ids, cosine)
    by_cluster = np.argsort(graph["cluster"], kind="stable")
    sorted_cluster = graph["cluster"][by_cluster]
    count = np.zeros(len(q), np.int64)
    names, where = np.unique(np.concatenate([ids, graph["ids"]]), return_inverse=True)
    mine, theirs = where[: len(ids)], where[len(ids) :]
    forest = np.arange(len(names))
    for s in range(0, len(q), BLOCK):
        node, sim = search(graph, x, q[s : s + BLOCK], width)
        r, c = np.nonzero((sim >= cosine - 1e-4) & (node >= 0))
        hits = np.unique(np.stack([r, graph["cluster"][node[r, c]]], axis=1), axis=0) if len(r) else np.zeros((0, 2), np.int64)
        pa, pb = [], []
        for cluster in np.unique(hits[:, 1]):
            ask = hits[hits[:, 1] == cluster, 0] + s
            lo, hi = np.searchsorted(sorted_cluster, [cluster, cluster + 1])
            for k in range(lo, hi, 1 << 14):  # a large cluster by parts
                have = by_cluster[k : min(k + (1 << 14), hi)]
                dots = vectors[ask] @ graph["vectors"][have].T
                close = dots / (norm_q[ask][:, None] * norm_x[have][None, :]) >= cosine
                close &= ids[ask][:, None] != graph["ids"][have][None, :]
                i, j = np.nonzero(close)
                count[ask] += close @ graph["weight"][have]
                pa.append(mine[ask[i]]), pb.append(theirs[have[j]])
        if pa:
            a, b = np.concatenate([*pa, np.arange(len(names))]), np.concatenate([*pb, forest])
            forest = roots(a, b, len(names))
    on = np.flatnonzero(forest != np.arange(len(names)))
    has = np.flatnonzero(count)
    return np.concatenate([ids[has], names[on]]), np.concatenate([ids[has], names[forest[on]]]), np.concatenate([count[has], np.zeros(len(on), np.int64)])


def _norm(vectors: np.ndarray) -> np.ndarray:
    return np.linalg.norm(vectors, axis=1)


def near_duplicates(rows: DataFrame, cosine: float = 0.95, n_shards: int | None = None, per_task: int = PER_TASK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do null ids; vectors
    of different lengths don't link. Rows of one id count as one vector, the smallest. n_shards: 8, or as many as hold
    PER_SHARD vectors each where there are more. An empty table gives no rows; other columns are not read.
    """
    ship(rows.sparkSession)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = slim.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))
    # very large and very small ones scaled, so that no square over- or underflows
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    good = good.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("top", top)
    good = good.select("vec_id", F.when((F.col("top") > 1e100) | (F.col("top") < 1e-100), F.transform("v", lambda x: x / F.col("top"))).otherwise(F.col("v")).alias("v"))
    good = cut(good, "vectors")
    same = good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    copies = cut(good.join(same, "v").select("vec_id", "first", "weight"), "copies")
    one = same.select(F.col("first").alias("vec_id"), "v", "weight", F.size("v").alias("dim"))
    if n_shards is None:
        n_shards = max(8, -(-good.count() // PER_SHARD))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")

    def make(group: pd.DataFrame) -> pd.DataFrame:
        graph = build(group["vec_id"].to_numpy(), np.stack(group["v"].to_numpy()), cosine, weight=group["weight"].to_numpy())
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "graph": [pickle.dumps(graph, protocol=5)]})

    graphs = cut(one.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, graph binary"), "graphs")
    splits = max(1, -(-good.count() // per_task))
    split = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(splits)).cast("int").alias("split")
    asked = one.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), split)
    dealt = graphs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))

    def ask(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        a, b, n = links(pickle.loads(graph["graph"].iloc[0]), queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), cosine)
        return pd.DataFrame({"a": a, "b": b, "n": n})

    keys = ["dim", "shard", "split"]
    found = cut(asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(ask, "a long, b long, n long"), "links")
    drop_cut(graphs, good)
    edges = found.select("a", "b").unionByName(copies.filter("vec_id != first").select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    whole = components(edges)
    n_links = found.groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    n_links = copies.join(n_links, "first", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = slim.select("vec_id").join(n_links, "vec_id", "left").join(whole.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
