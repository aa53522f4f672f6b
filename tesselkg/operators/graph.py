"""Iterative graph operators over (grp, u, v) edge tables; all groups advance in the same jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselkg.session import cut

#: Damping of the walk, and its most rounds.
ALPHA, MOST_ROUNDS = 0.85, 100
#: Rounds between two cuts of the lineage.
CUT_EVERY = 5
#: Edges that one task may finish a graph of, and edges a task buffers before it drops those that close cycles.
MOST_IN_TASK, BUFFER = 1_000_000, 200_000
#: Graphs of at most so many vertices are returned whole.
SMALL_GRAPH = 50


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, *, rounds: int = MOST_ROUNDS, alpha: float = ALPHA, tolerance: float | None = 1e-6) -> DataFrame:
    """(grp, node, score) of random walks with restart at the group's seeds (grp, node) that are in its graph.

    ``edges`` are undirected pairs (grp, u, v). Mass of vertices without edges
    follows the restart; groups without a present seed get equal scores. Stops
    after ``rounds``, or when the total change of every group is below its
    number of vertices times ``tolerance`` (tested when lineage is cut; None:
    never).
    """
    both = edges.select("grp", F.col("u").alias("s"), F.col("v").alias("t")).unionByName(edges.select("grp", F.col("v").alias("s"), F.col("u").alias("t")))
    degree = both.groupBy("grp", "s").agg(F.count(F.lit(1)).alias("deg"))
    both = cut(both.join(degree, ["grp", "s"]))
    named = both.select("grp", F.col("s").alias("node")).unionByName(seeds.select("grp", "node")).distinct()
    present = seeds.select("grp", "node").distinct().withColumn("seed", F.lit(1))
    nodes = named.join(present, ["grp", "node"], "left")
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("n_seeds"))
    dangling = nodes.join(degree.select("grp", F.col("s").alias("node"), F.lit(1).alias("linked")), ["grp", "node"], "left")
    nodes = cut(
        dangling.join(sizes, "grp").select(
            "grp", "node", "n",
            F.when(F.col("n_seeds") == 0, 1.0 / F.col("n")).when(F.col("seed") == 1, 1.0 / F.col("n_seeds")).otherwise(0.0).alias("restart"),
            F.col("linked").isNull().alias("dangling"),
            (1.0 / F.col("n")).alias("score"),
        )
    )
    before = nodes
    for step in range(1, rounds + 1):
        flow = both.join(nodes.select("grp", F.col("node").alias("s"), "score"), ["grp", "s"]).groupBy("grp", F.col("t").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("flow"))
        lost = nodes.groupBy("grp").agg(F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost"))
        score = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("restart")) + F.lit(1 - alpha) * F.col("restart")
        nodes = nodes.drop("score").join(flow, ["grp", "node"], "left").join(lost, "grp").select("grp", "node", "n", "restart", "dangling", score.alias("score"))
        if step % CUT_EVERY == 0:
            nodes = cut(nodes)
            if tolerance is not None:
                change = nodes.join(before.select("grp", "node", F.col("score").alias("was")), ["grp", "node"])
                moving = change.groupBy("grp").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d"), F.max("n").alias("n")).where(F.col("d") >= F.col("n") * tolerance)
                if not moving.limit(1).count():
                    break
                before = nodes
    return nodes.select("grp", "node", "score")


def pagerank_of_groups(edges: DataFrame, seeds: DataFrame, *, rounds: int = MOST_ROUNDS, alpha: float = ALPHA, tolerance: float = 1e-6) -> DataFrame:
    """The same walk for many small graphs: each group (one query's neighbourhood) in one task, without rounds of joins."""

    def walk(pairs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([pairs["u"], pairs["v"], start["node"]]).astype(str), return_inverse=True)
        n, m = len(names), len(pairs)
        u, v, s = code[:m], code[m : 2 * m], np.unique(code[2 * m :])
        source, target = np.r_[u, v], np.r_[v, u]
        degree = np.bincount(source, minlength=n)
        restart = np.zeros(n)
        restart[s] = 1 / len(s) if len(s) else 0
        if not len(s):
            restart[:] = 1 / n
        x = np.full(n, 1 / n)
        for _ in range(rounds):
            flow = np.bincount(target, x[source] / degree[source], n) if m else np.zeros(n)
            new = alpha * (flow + x[degree == 0].sum() * restart) + (1 - alpha) * restart
            change, x = np.abs(new - x).sum(), new
            if change < n * tolerance:
                break
        group = (pairs if m else start)["grp"].iloc[0]
        return pd.DataFrame({"grp": group, "node": names, "score": x})

    left, right = edges.select("grp", "u", "v"), seeds.select("grp", "node")
    return left.groupBy("grp").cogroup(right.groupBy("grp")).applyInPandas(walk, "grp string, node string, score double")


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    keep = []
    for place, u, v in edges.sort_values(["cost", "u", "v"])[["u", "v"]].itertuples():
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            keep.append(place)
    return edges.loc[keep]


def spanning_forests(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of each group's graph (grp, u, v, cost, ...), by (cost, u, v): one group is one query's small graph."""
    return edges.groupBy("grp").applyInPandas(_kruskal, edges.schema)


def local_forests(edges: DataFrame) -> DataFrame:
    """Of the edges (u, v, cost, ...) of one graph those that can be in its minimum spanning forest, as far as each task can tell.

    An edge that closes a cycle of lesser ones within a task's edges is in no
    forest. A task holds its forest and one buffer of edges.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size > 2 * BUFFER:
                held = [_kruskal(pd.concat(held, ignore_index=True))]
                size = len(held[0])
        if held:
            yield _kruskal(pd.concat(held, ignore_index=True))

    return edges.where("u != v").mapInPandas(keep, edges.schema)


def minimum_forest(edges: DataFrame, most: int = MOST_IN_TASK) -> DataFrame:
    """The minimum spanning forest of one graph of any size (u, v, cost, ...; pairs unique), by (cost, u, v).

    First every task drops the edges that close cycles within its own. What is left
    is finished in one task while it is within ``most`` edges, else in rounds of joins.
    """
    left = cut(local_forests(edges))
    if left.count() <= most:
        return left.groupBy(F.lit(1).alias("one")).applyInPandas(lambda g: _kruskal(g.drop(columns="one", errors="ignore")), edges.schema)
    return left.join(boruvka(left).select("u", "v"), ["u", "v"], "left_semi").select(edges.columns)


def boruvka(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of one graph of any size (u, v, cost), by (cost, u, v), in rounds of joins.

    Each round every component takes its least outgoing edge; components are
    merged by pointer jumping. At most log2(vertices) rounds, each cut.
    """
    base = cut(edges.where("u != v").select("u", "v", "cost", F.struct("cost", "u", "v").alias("w")))
    label = cut(base.select(F.col("u").alias("x")).unionByName(base.select(F.col("v").alias("x"))).distinct().withColumn("c", F.col("x")))
    chosen = None
    while True:
        ends = base.join(label.select(F.col("x").alias("u"), F.col("c").alias("cu")), "u").join(label.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").where("cu != cv")
        out = ends.select(F.col("cu").alias("c"), F.col("cv").alias("d"), "w").unionByName(ends.select(F.col("cv").alias("c"), F.col("cu").alias("d"), "w"))
        least = cut(out.groupBy("c").agg(F.min(F.struct("w", "d")).alias("m")).select("c", "m.w", "m.d"))
        if not least.limit(1).count():
            break
        found = least.select("w.u", "w.v", "w.cost").distinct()
        chosen = found if chosen is None else cut(chosen.unionByName(found))
        # of two components that chose each other the smaller is the root
        back = least.select(F.col("c").alias("d"), F.col("d").alias("back"))
        up = cut(least.join(back, "d", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p")))
        while True:
            jump = cut(up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
            up = jump.select("c", "p")
            if not jump.where("moved").limit(1).count():
                break
        label = cut(label.join(up, "c", "left").select("x", F.coalesce("p", "c").alias("c")))
    return base.select("u", "v", "cost").limit(0) if chosen is None else chosen


def _pruned(tree: pd.DataFrame, keep: set[str]) -> pd.DataFrame:
    """The tree without the leaves that are not kept, nor those that become leaves by that."""
    near: dict[str, set[str]] = {}
    for u, v in zip(tree["u"], tree["v"]):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    loose = [x for x, n in near.items() if len(n) == 1 and x not in keep]
    while loose:
        x = loose.pop()
        for y in near.pop(x):
            near[y].discard(x)
            if len(near[y]) == 1 and y not in keep:
                loose.append(y)
    return tree[[u in near and v in near[u] for u, v in zip(tree["u"], tree["v"])]]


def steiner_subtrees(forest: DataFrame, important: DataFrame) -> DataFrame:
    """The union of the paths between a group's important vertices (grp, node) in its forest: leaves that are not important fall off until none is left.

    One group, a query's small graph or one within the bound of a task, is one task.
    """
    def prune(tree: pd.DataFrame, keep: pd.DataFrame) -> pd.DataFrame:
        return _pruned(tree, set(keep["node"]))

    left = forest.select(*[F.col(c).alias(c) for c in forest.columns])  # columns of its own, though both may be of one origin
    return left.groupBy("grp").cogroup(important.select("grp", "node").groupBy("grp")).applyInPandas(prune, forest.schema)


def steiner_subtree(forest: DataFrame, important: DataFrame, most: int = MOST_IN_TASK) -> DataFrame:
    """The same of one graph of any size: in one task while its forest is within ``most`` edges, else a round of joins per layer of leaves."""
    tree = cut(forest)
    if tree.count() <= most:
        return steiner_subtrees(tree, important)
    keep = cut(important.select("grp", "node").distinct())
    while True:
        ends = tree.select("grp", F.explode(F.array("u", "v")).alias("node"))
        loose = cut(ends.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("deg")).where("deg = 1").join(keep, ["grp", "node"], "left_anti").select("grp", "node"))
        if not loose.limit(1).count():
            return tree
        tree = tree.join(loose.select("grp", F.col("node").alias("u")), ["grp", "u"], "left_anti")
        tree = cut(tree.join(loose.select("grp", F.col("node").alias("v")), ["grp", "v"], "left_anti"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the group's nodes (grp, node)."""
    within = nodes.select("grp", "node").distinct()
    return edges.join(within.select("grp", F.col("node").alias("u")), ["grp", "u"], "left_semi").join(within.select("grp", F.col("node").alias("v")), ["grp", "v"], "left_semi")


def connected_evidence(edges: DataFrame, important: DataFrame) -> DataFrame:
    """The evidence subgraph per group: small graphs whole, graphs with fewer than two important vertices induced on them, else the Steiner subtree.

    If no two important vertices are connected, the subgraph induced on them.
    Important vertices (grp, node) are vertices of the graph, with edges or not.
    """
    ends = edges.select("grp", F.explode(F.array("u", "v")).alias("node")).distinct()
    size = ends.unionByName(important.select("grp", "node")).distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n_nodes"))
    held = ends.join(important.select("grp", "node").distinct(), ["grp", "node"])
    count = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n_held"))
    kind = cut(size.join(count, "grp", "left").select("grp", F.when(F.col("n_nodes") <= SMALL_GRAPH, "whole").when(F.coalesce("n_held", F.lit(0)) < 2, "induced").otherwise("tree").alias("form")))
    of = lambda form: edges.join(kind.where(F.col("form") == form).select("grp"), "grp", "left_semi")
    tree = steiner_subtrees(spanning_forests(of("tree")), held)
    none = kind.where("form = 'tree'").join(tree.select("grp").distinct(), "grp", "left_anti").select("grp")
    rest = induced(of("induced").unionByName(of("tree").join(none, "grp", "left_semi")), held)
    return of("whole").unionByName(tree.select(edges.columns)).unionByName(rest.select(edges.columns))
