"""The k most similar vectors of every vector, by robust-pruned directed graphs.

Vectors of one kind are spread over overlapping shards: centroids are fitted on
a bounded sample of each crowded cell, in one task per cell, and every vector
joins the shards of its nearest centroids, so neighbours meet in at least one of
them. In each shard a directed graph is built: greedy beam searches propose
neighbours of each vector, relaxed distance pruning keeps edges that differ in
direction, and back edges are pruned alike. Then every vector's beam search runs
in each of its shards, and the best of all shards are merged by exact
similarity.

Exact copies are one vector with a list of ids. Shards are bounded: a cell that
outgrows its size is divided again by centroids of its own; what stays too dense
after that is split by hash, one graph per part, and its vectors search every
part. Neither vectors nor centroids pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkg.session import cut, default_parallelism

#: Vectors a shard should hold, and from how many it is split again.
SHARD, SPLIT = 1500, 6000
#: Shards each vector joins.
OVERLAP = 2
#: Of each crowded cell: vectors its centroids are fitted on, and centroids, at most. Turns of division.
SAMPLE, FAN, TURNS = 16_384, 512, 4
#: Vectors that one task routes at a time, and rows of the table of crowded cells that may be broadcast.
BLOCK, MOST_CELLS = 50_000, 100_000
#: Out-edges after pruning and at most; beam width when a vector is inserted and when it asks; relaxation of the pruning; vectors searched at a time; vectors expanded per step.
DEGREE, FULL, BEAM, ASK_BEAM, RELAX, BATCH, STEP = 12, 20, 16, 12, 1.2, 512, 4


def unit_rows(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` nearest found for each query, by best-first search over the graph; -1 pads.

    ``x`` and ``graph`` have a last row that stands for no vector. All queries
    advance together: each step expands every query's nearest unexpanded vectors.
    """
    n, q = len(x) - 1, len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(q)
    width = starts.shape[1]
    ids = np.full((q, beam), n, np.int32)
    dist = np.full((q, beam), np.inf, np.float32)
    ids[:, :width] = starts
    dist[:, :width] = 1 - np.matmul(x[starts], queries[:, :, None])[:, :, 0]
    for j in range(1, width):  # a start given twice counts once
        dist[(starts[:, :j] == starts[:, j : j + 1]).any(axis=1), j] = np.inf
    seen[rows[:, None], starts] = True
    done = ~np.isfinite(dist)
    active = rows
    while len(active):
        a_dist, a_done, a_ids = dist[active], done[active], ids[active]
        pick = np.argpartition(np.where(a_done, np.inf, a_dist), min(STEP, beam) - 1, axis=1)[:, :STEP]
        fresh = ~np.take_along_axis(a_done, pick, 1)
        alive = fresh.any(axis=1)
        if not alive.all():
            active, a_dist, a_done, a_ids, pick, fresh = (y[alive] for y in (active, a_dist, a_done, a_ids, pick, fresh))
            if not len(active):
                break
        nodes = np.where(fresh, np.take_along_axis(a_ids, pick, 1), n)
        np.put_along_axis(a_done, pick, True, 1)
        near = np.sort(graph[nodes].reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        known = seen[active[:, None], near]
        seen[active[:, None], near] = True
        near[known] = n
        d = 1 - np.matmul(x[near], queries[active][:, :, None])[:, :, 0]
        d[known] = np.inf
        all_d = np.concatenate([a_dist, d], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(all_d, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([a_ids, near], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([a_done, known], axis=1), keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-edges for each point from its candidates (-1 or the last row pad), nearest first: a kept edge drops the candidates that it is ``relax`` times nearer to."""
    n = len(x) - 1
    candidates = np.sort(np.where(candidates < 0, n, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n  # a candidate given twice counts once
    candidates[candidates == points[:, None]] = n
    vectors = x[candidates]
    d = 1 - np.matmul(vectors, x[points][:, :, None])[:, :, 0]
    d[candidates == n] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d, vectors = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(vectors, order[:, :, None], 1)
    covered = relax * (1 - np.matmul(vectors, vectors.transpose(0, 2, 1))) <= d[:, None, :]
    live = np.isfinite(d)
    out = np.full((len(points), degree), n, np.int32)
    rows = np.arange(len(points))
    for place in range(degree):
        pick = live.argmax(axis=1)
        has = live[rows, pick]
        if not has.any():
            break
        out[has, place] = candidates[rows[has], pick[has]]
        live &= ~covered[rows, pick]
        live[rows, pick] = False
    return out


def padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])


def entry_point(x: np.ndarray) -> int:
    return int(np.argmax(x[:-1] @ x[:-1].mean(axis=0)))


def build_graph(x: np.ndarray, *, degree: int = DEGREE, full: int = FULL, beam: int = BEAM, relax: float = RELAX, seed: int = 7) -> np.ndarray:
    """The out-edges of a shard's graph (a row per row of the padded ``x``), grown in random order by doubling batches.

    Back edges are added to a vector's list; one that is full is pruned again.
    """
    n = len(x) - 1
    graph = np.full((n + 1, full), n, np.int32)
    if n <= 1:
        return graph
    count = np.zeros(n, np.int64)
    entry = entry_point(x)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([np.array([entry], np.int32), order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(x, graph, x[batch], np.full((len(batch), 1), entry), beam)
        close = x[batch] @ x[batch].T  # vectors of one batch do not see each other in the graph yet
        mates = min(9, len(batch))
        own = np.concatenate([found, batch[np.argpartition(-close, mates - 1, axis=1)[:, :mates]]], axis=1)
        edges = robust_prune(x, batch, own, degree, relax)
        graph[batch, :degree] = edges
        count[batch] = (edges < n).sum(axis=1)
        source, target = np.repeat(batch, degree), edges.ravel()
        source, target = source[target < n], target[target < n]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        start = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(target)])
        nodes = target[start]
        place = np.arange(len(target)) - np.repeat(start, size)
        fits = count[nodes] + size <= full
        room = np.repeat(fits, size)
        graph[target[room], (count[target] + place)[room]] = source[room]
        count[nodes[fits]] += size[fits]
        if not fits.all():
            over, more = nodes[~fits], np.full((np.count_nonzero(~fits), int(size[~fits].max())), n, np.int32)
            more[np.repeat(np.arange(len(over)), size[~fits]), place[~room]] = source[~room]
            kept = robust_prune(x, over, np.concatenate([graph[over], more], axis=1), degree, relax)
            graph[over, :degree], graph[over, degree:] = kept, n
            count[over] = (kept < n).sum(axis=1)
    return graph


def shard_neighbours(
    x: np.ndarray, k: int, *, queries: np.ndarray | None = None, graph: np.ndarray | None = None, beam: int = ASK_BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k nearest of each query (by default of each vector of the shard itself, itself left out); -1 pads."""
    n, own = len(x), queries is None
    queries = x if own else queries
    x = padded(x)
    graph = build_graph(x) if graph is None else graph
    entry = entry_point(x)
    ids, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    beam = max(beam, k + 1)
    for at in range(0, len(queries), BATCH):
        q = queries[at : at + BATCH]
        me = np.arange(at, at + len(q))
        starts = np.full((len(q), 1), entry)
        if own:
            starts = np.stack([me, starts[:, 0]], axis=1)
        found, d = beam_search(x, graph, q, starts, beam)
        d = np.where((found < 0) | (own & (found == me[:, None])), np.inf, d)
        take = np.argsort(d, axis=1, kind="stable")[:, :k]
        got, dd = np.take_along_axis(found, take, 1), np.take_along_axis(d, take, 1)
        ids[at : at + len(q)] = np.where(np.isfinite(dd), got, -1)
        sims[at : at + len(q)] = np.where(np.isfinite(dd), 1 - dd, -np.inf)
    return ids, sims


def _centroids(sample: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), count, replace=False)]
    for _ in range(6):
        best = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres.astype(np.float32)


def _small(table: DataFrame) -> DataFrame:
    """A table with one row per crowded cell, broadcast while it is within its bound."""
    return F.broadcast(table) if table.count() <= MOST_CELLS else table


def _divided(placed: DataFrame, crowded: DataFrame, shard: int, overlap: int, sample: int, fan: int, block: int) -> DataFrame:
    """The vectors of the ``crowded`` cells (kind, cell, n, again), each in the cells of its nearest centroids.

    A cell's centroids are fitted in one task on at most about ``sample`` of its
    vectors; its vectors are routed in blocks, so no task holds a cell. A cell that
    gives fewer than two centroids stays.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        n, wide = int(group["n"].iloc[0]), bool(group["wide"].iloc[0])
        count = min(max(1, round(n / (shard / overlap if wide else shard))), fan, len(group) // 4)
        centres = _centroids(unit_rows(group["v"].tolist()), count).tobytes() if count > 1 else None
        return pd.DataFrame({"kind": group["kind"].iloc[:1], "cell": group["cell"].iloc[:1], "wide": wide, "centres": [centres]})

    rated = placed.join(_small(crowded), ["kind", "cell"])
    chosen = rated.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < F.lit(1e6 * sample) / F.col("n"))
    fitted = cut(chosen.groupBy("kind", "cell").applyInPandas(fit, "kind string, cell long, wide boolean, centres binary"))

    def route(vectors: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        out = vectors[["kind", "cell", "id", "v"]]
        if not len(out) or not len(fit) or fit["centres"].iloc[0] is None:
            return out
        x = unit_rows(out["v"].tolist())
        c = np.frombuffer(fit["centres"].iloc[0], np.float32).reshape(-1, x.shape[1])
        near = np.argsort(-(x @ c.T), axis=1)[:, : overlap if fit["wide"].iloc[0] else 1]
        # a new cell's number is drawn from its mother's and its place
        return pd.concat([out.assign(cell=(out["cell"].to_numpy() * 1_000_003 + near[:, j] + 1)) for j in range(near.shape[1])])

    salts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    asked = rated.select("kind", "cell", "id", "v", F.pmod(F.xxhash64("id", F.lit(9)), salts).cast("int").alias("salt"))
    told = crowded.select("kind", "cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(fitted, ["kind", "cell"])
    told = told.select(*[F.col(c).alias(c) for c in told.columns])  # columns of its own, though of one origin
    return asked.groupBy("kind", "cell", "salt").cogroup(told.groupBy("kind", "cell", "salt")).applyInPandas(route, "kind string, cell long, id long, v array<float>")


def _search_shards(reps: DataFrame, k: int, shard: int, split: int, overlap: int, sample: int, fan: int, block: int) -> DataFrame:
    """(kind, id, other, sim) of the k nearest distinct vectors found for each; vectors of different lengths are never together."""
    placed = reps.select("kind", F.size("v").cast("long").alias("cell"), "id", "v")
    for turn in range(TURNS):
        loads = placed.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n"))
        # a cell too large for one turn's centroids is divided with overlap again
        crowded = cut(loads.where(F.col("n") > (shard if turn == 0 else split)).withColumn("wide", F.lit(turn == 0) | (F.col("n") > fan * shard)))
        if not crowded.limit(1).count():
            break
        rest = placed.join(_small(crowded.select("kind", "cell")), ["kind", "cell"], "left_anti")
        placed = cut(rest.unionByName(_divided(placed, crowded, shard, overlap if turn == 0 else min(overlap, 2), sample, fan, block)))
    loads = cut(placed.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n")))
    dense = loads.where(F.col("n") > split).select("kind", "cell", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("parts"))
    tasks = min(max(default_parallelism(reps.sparkSession), loads.count() // 3), 20_000)  # building takes time, not memory: small groups are not put together
    form = "kind string, id long, other long, sim double"

    def pairs(kind: str, who: np.ndarray, names: np.ndarray, got: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        other = np.where(got >= 0, names[np.maximum(got, 0)], who[:, None])
        ok = (other != who[:, None]).ravel()
        return pd.DataFrame({"kind": kind, "id": np.repeat(who, got.shape[1])[ok], "other": other.ravel()[ok], "sim": sims.ravel()[ok]})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        return pairs(group["kind"].iloc[0], ids, ids, *shard_neighbours(unit_rows(group["v"].tolist()), k))

    whole = placed.join(_small(dense), ["kind", "cell"], "left_anti")
    found = whole.repartition(tasks, "kind", "cell").groupBy("kind", "cell").applyInPandas(search, form)
    if not dense.limit(1).count():
        return found

    # what is still too dense: parts by hash, one graph each; every vector asks every part, in blocks
    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(group["v"].tolist())
        one = group.iloc[:1]
        return pd.DataFrame({"kind": one["kind"], "cell": one["cell"], "part": one["part"], "parts": one["parts"], "ids": [group["id"].to_numpy().tobytes()], "x": [x.tobytes()], "graph": [build_graph(padded(x)).tobytes()]})

    def ask(vectors: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(part):
            return pd.DataFrame({"kind": [], "id": [], "other": [], "sim": []})
        q, names = unit_rows(vectors["v"].tolist()), np.frombuffer(part["ids"].iloc[0], np.int64)
        x = np.frombuffer(part["x"].iloc[0], np.float32).reshape(len(names), -1)
        graph = np.frombuffer(part["graph"].iloc[0], np.int32).reshape(len(names) + 1, -1)
        return pairs(vectors["kind"].iloc[0], vectors["id"].to_numpy(), names, *shard_neighbours(x, k + 1, queries=q, graph=graph))  # one more: the vector finds itself in its own part

    crowd = placed.join(_small(dense), ["kind", "cell"])
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    stored = crowd.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    graphs = cut(stored.groupBy("kind", "cell", "part").applyInPandas(build, "kind string, cell long, part int, parts int, ids binary, x binary, graph binary"))
    asking = crowd.select("kind", "cell", "id", "v", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("block"), every.alias("part"))
    key = ["kind", "cell", "part", "block"]
    told = graphs.select(*[F.col(c).alias(c) for c in ("kind", "cell", "part")], every.alias("block"), "ids", "x", "graph")
    return found.unionByName(asking.groupBy(key).cogroup(told.groupBy(key)).applyInPandas(ask, form))


def _first_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar of each id, from its few candidates; a candidate found in several shards counts once."""
    ranked = pairs.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))).alias("near"))
    first = lambda x, i: F.array_position(F.col("near.other"), x["other"]) == i + 1
    spread = ranked.select("kind", "id", F.posexplode(F.slice(F.filter("near", first), 1, k)).alias("p", "n"))
    return spread.select("kind", "id", F.col("n.other").alias("other"), (-F.col("n.far")).alias("sim"), (F.col("p") + 1).cast("int").alias("rank"))


def nearest_neighbours(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", kind: Column | None = None, k: int = 5,
    shard: int = SHARD, split: int = SPLIT, overlap: int = OVERLAP, sample: int = SAMPLE, fan: int = FAN, block: int = BLOCK,
) -> DataFrame:
    """(kind, id, other, sim, rank): for each vector its k most similar others of the same kind, by cosine; ties go to the smaller id.

    Null vectors, zero vectors and vectors with missing or infinite values take no
    part, nor do rows without id or kind; vectors of different lengths are never
    compared; a repeated id counts once. A kind of one vector gives no rows; an
    empty table gives none. Recall against brute force: see the README.
    """
    kinds = kind if kind is not None else F.lit("")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    base = vectors.select(kinds.alias("kind"), F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("kind is not null and id is not null and v is not null")
    base = base.withColumn("sq", F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x * x)).where("sq > 0 and sq < double('infinity')")
    once = base.groupBy("kind", "id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    base = cut(once.select("kind", "id", F.transform("v", lambda x: x.cast("float")).alias("v")))
    classes = cut(base.groupBy("kind", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    near = _search_shards(classes.select("kind", F.col("rep").alias("id"), "v"), k, shard, split, overlap, sample, fan, block)
    if not classes.where("n > 1").limit(1).count():
        return _first_k(near, k)
    # copies: each id takes part with the first k + 1 ids of every class it meets, its own included
    members = base.join(classes.select("kind", "v", "rep"), ["kind", "v"]).select("kind", "rep", "id")
    order = Window.partitionBy("kind", "rep").orderBy("id")
    firsts = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("kind", F.col("rep").alias("met"), F.col("id").alias("other"))
    met = _first_k(near, k).select("kind", F.col("id").alias("rep"), F.col("other").alias("met"), "sim")
    met = met.unionByName(classes.select("kind", "rep", F.col("rep").alias("met"), F.lit(1.0).alias("sim")))
    pairs = members.join(met.join(firsts, ["kind", "met"]), ["kind", "rep"]).where("id != other").select("kind", "id", "other", "sim")
    return _first_k(pairs, k)
