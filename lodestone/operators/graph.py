"""Typed property graphs as vertex and edge tables: lookups, reachability, cycles, components, PageRank.

Iterative operators loop over frontier joins. A level is written below spark.checkpoint.dir before it is used again, so a
lost executor costs that level alone. Graphs below a checked size are ranked in one task instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpoint_root

DEPENDENCIES = ("IMPORTS", "CALLS", "INHERITS")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: its lineage ends there."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def last_edges(log: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the last of the log by seq; the log keeps all."""
    rest = [c for c in log.columns if c not in ("src", "dst")]
    return log.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "seq").alias("_x")).select("src", "dst", "_x.*")


def search_nodes(vertices: DataFrame, query: str, node_type: str | None = None, limit: int = 50) -> DataFrame:
    """Case-insensitive substring of name, path or id, in insertion order."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.contains(F.lower(F.coalesce("relative_path", F.lit(""))), q) | F.contains(F.lower("id"), q)
    out = vertices.where(hit)
    if node_type:
        out = out.where(F.col("node_type") == node_type)
    return out.orderBy("seq", "id").limit(limit)


def graph_view(vertices: DataFrame, edges: DataFrame, node_type: str | None = None, contains: str | None = None, edge_type: str | None = None, max_nodes: int = 200):
    """(vertices, edges) of the first max_nodes that match, with the edges among them."""
    v = vertices
    if node_type:
        v = v.where(F.col("node_type") == node_type)
    if contains:
        v = v.where(F.contains(F.lower("name"), F.lit(contains.lower())) | F.contains(F.lower("id"), F.lit(contains.lower())))
    v = v.orderBy("seq", "id").limit(max_nodes)
    e = edges.where(F.col("edge_type") == edge_type) if edge_type else edges
    ids = v.select("id")
    return v, e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbors(edges: DataFrame, vertices: DataFrame, node, edge_type: str = "CALLS", incoming: bool = True) -> DataFrame:
    a, b = ("dst", "src") if incoming else ("src", "dst")
    e = edges.where((F.col("edge_type") == edge_type) & (F.col(a) == node)).withColumnRenamed(b, "id").drop(a)
    return e.join(vertices, "id")


def reach(edges: DataFrame, start: DataFrame, max_depth: int, edge_types=None, incoming: bool = False, with_start: bool = False) -> DataFrame:
    """(root, node, depth, relationship, path): the first arrival at every node, by depth and then by node before it.

    start: column ``root``. One frontier join and one anti join a level.
    """
    e = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    a, b = ("dst", "src") if incoming else ("src", "dst")
    e = e.select(F.col(a).alias("_at"), F.col(b).alias("_to"), "edge_type")
    frontier = start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relationship"), F.array("root").alias("path"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, frontier.node == e["_at"]).select("root", F.col("_to").alias("node"), "edge_type", "path", F.col("_at").alias("_from"))
        first = step.groupBy("root", "node").agg(F.min_by(F.struct("edge_type", "path"), F.struct("_from", "edge_type")).alias("x"))
        fresh = first.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(fresh.select("root", "node", F.lit(depth).alias("depth"), F.col("x.edge_type").alias("relationship"), F.concat("x.path", F.array("node")).alias("path")), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if with_start else seen.where("depth > 0")


def trace_impact(edges: DataFrame, vertices: DataFrame, node, max_depth: int = 3, edge_types=DEPENDENCIES) -> DataFrame:
    """All that reaches a node within max_depth, with its type, sorted by depth and name."""
    start = edges.sparkSession.createDataFrame([(node,)], f"root {vertices.schema['id'].dataType.simpleString()}")
    found = reach(edges, start, max_depth, edge_types, incoming=True)
    return found.join(vertices.withColumnRenamed("id", "node"), "node").orderBy("depth", "name", "node")


def longest_path(edges: DataFrame, node, max_depth: int = 12, edge_types=DEPENDENCIES) -> int:
    """Length of the longest simple path from a node, up to max_depth."""
    e = edges.where(F.col("edge_type").isin(*edge_types)).select("src", "dst").distinct()
    paths = e.where(F.col("src") == node).where("dst <> src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    depth = 0
    while depth < max_depth and not paths.isEmpty():
        depth += 1
        paths = written(
            paths.join(e, paths.at == e.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")), "paths"
        )
    return depth


def simple_cycles(edges: DataFrame, max_length: int = 6, limit: int | None = None) -> DataFrame:
    """(cycle, length): elementary cycles, each once, from its smallest node: paths only pass nodes larger than their start."""
    e = edges.select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    paths = e.where("src < dst").select(F.col("src").alias("anchor"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = loops
    for length in range(2, max_length + 1):
        closing = e.select(F.col("src").alias("at"), F.col("dst").alias("anchor"))
        found = found.unionByName(paths.join(closing, ["at", "anchor"]).select(F.col("path").alias("cycle")))
        if length < max_length:
            step = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
            paths = paths.join(step, "at").where((F.col("to") > F.col("anchor")) & ~F.array_contains("path", F.col("to"))).select("anchor", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
            paths = written(paths, "cycles")
    out = found.withColumn("length", F.size("cycle"))
    return out.orderBy("length", "cycle").limit(limit) if limit is not None else out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to or from, again and again: all edges of cycles stay."""
    n = edges.count()
    while n:
        sources, targets = edges.select("src").distinct(), edges.select("dst").distinct()
        kept = edges.join(targets.select(F.col("dst").alias("src")), "src", "left_semi").join(sources.select(F.col("src").alias("dst")), "dst", "left_semi")
        edges, before = written(kept.select("src", "dst"), "scc"), n
        n = edges.count()
        if n == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component of two nodes or more.

    Coloring: the smallest node that reaches a node, and the smallest that it reaches, are spread to a fixed point; nodes
    with both equal are a component and leave; the rest goes on until nothing is left, which it does as each round takes the
    smallest node at least. Before each round chains that lead into cycles or out of them are trimmed.
    """
    left = written(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    done = None
    while not (left := _trimmed(left)).isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        color = _spread(nodes.withColumn("c", F.col("node")), left, "src", "dst")
        inside = left.join(color.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", "cs")
        back = _spread_to_root(written(color, "scc"), written(inside, "scc"))
        done = back if done is None else done.unionByName(back)
        gone = back.select("node")
        left = written(
            inside.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "scc"
        )
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    size = Window.partitionBy("component")
    return done.withColumn("_n", F.count("*").over(size)).where("_n > 1").drop("_n")


def _spread(state: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest value spread along edges until nothing changes."""
    state = written(state, "spread")
    while True:
        step = edges.join(state.select(F.col("node").alias(a), "c"), a).groupBy(F.col(b).alias("node")).agg(F.min("c").alias("_c"))
        new = written(state.join(step, "node", "left").select("node", F.least("c", F.coalesce("_c", "c")).alias("c"), (F.coalesce("_c", "c") < F.col("c")).alias("moved")), "spread")
        if new.where("moved").isEmpty():
            return new.select("node", "c")
        state = new.select("node", "c")


def _spread_to_root(color: DataFrame, inside: DataFrame) -> DataFrame:
    """Nodes of each color that reach the node the color is named after: they are its component."""
    found = frontier = color.where("node = c").select("node", F.col("c").alias("component"))
    while True:
        step = inside.join(frontier.select(F.col("node").alias("dst"), "component"), "dst").where("cs = component").select(F.col("src").alias("node"), "component").distinct()
        frontier = written(step.join(found.select("node"), "node", "left_anti"), "root")
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier), "root")


#: Graphs of at most so many edges (16 bytes each) are ranked in one task.
ONE_TASK_EDGES = 1_000_000


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100, fixed: bool = False, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, rank): distinct edges, self-loops kept, dangling mass spread evenly, L1 stop, normalised, 6 digits.

    fixed: run exactly max_iterations and do not normalise.
    """
    e = edges.select("src", "dst").distinct()
    v = e.select(F.col("src").alias("node")).union(e.select("dst"))
    v = (v.union(nodes.select("node")) if nodes is not None else v).distinct()
    if e.limit(one_task + 1).count() <= one_task and v.limit(one_task + 1).count() <= one_task:
        return _pagerank_one_task(e, v, damping, tolerance, max_iterations, fixed)
    e, v = written(e, "pagerank"), written(v, "pagerank")
    n = v.count()
    degree = e.groupBy("src").agg(F.count("*").alias("d"))
    links = written(e.join(degree, "src"), "pagerank")
    state = v.withColumn("r", F.lit(1.0 / n))
    for _ in range(max_iterations):
        flow = links.join(state.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") / F.col("d")).alias("f"))
        loose = state.join(degree.select(F.col("src").alias("node")), "node", "left_anti").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        new = state.join(flow, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * (F.coalesce("f", F.lit(0.0)) + loose / n)).alias("r"), F.col("r").alias("old"))
        new = written(new, "pagerank")
        change = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        state = new.select("node", "r")
        if not fixed and change < tolerance:
            break
    total = 1.0 if fixed else state.agg(F.sum("r")).first()[0]
    return state.select("node", F.round(F.col("r") / total, 6).alias("rank"))


def _pagerank_one_task(e: DataFrame, v: DataFrame, damping: float, tolerance: float, rounds: int, fixed: bool) -> DataFrame:
    kind = v.schema["node"].dataType.simpleString()
    rows = v.select(F.col("node").alias("a"), F.lit(None).cast(kind).alias("b")).unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))

    def rank(batches):
        import numpy as np
        import pandas as pd

        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        df = pd.concat(parts)
        nodes = np.array(sorted(df.a[df.b.isna()].tolist()), object)
        at = {x: i for i, x in enumerate(nodes.tolist())}
        df = df[df.b.notna()]
        src, dst = (np.array([at[x] for x in df[c].tolist()], int) for c in "ab")
        order = np.lexsort((dst, src))
        src, dst, n = src[order], dst[order], len(nodes)
        degree = np.bincount(src, minlength=n)
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            share = np.where(degree > 0, r / np.maximum(degree, 1), 0)
            new = (1 - damping) / n + damping * (np.bincount(dst, weights=share[src], minlength=n) + r[degree == 0].sum() / n)
            change, r = np.abs(new - r).sum(), new
            if not fixed and change < tolerance:
                break
        yield pd.DataFrame({"node": nodes, "r": r if fixed else r / r.sum()})

    ranked = rows.coalesce(1).mapInPandas(rank, f"node {kind}, r double")
    return ranked.select("node", F.round("r", 6).alias("rank"))


def betweenness(edges: DataFrame, center, hops: int = 2, most_nodes: int = 5000) -> float:
    """Betweenness of a node in its undirected neighbourhood, by Brandes' sums; the neighbourhood is bounded by most_nodes."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().withColumn("edge_type", F.lit("E"))
    start = edges.sparkSession.createDataFrame([(center,)], f"root {edges.schema['src'].dataType.simpleString()}")
    near = reach(both, start, hops, with_start=True).select("node").limit(most_nodes)
    rows = both.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.src, []).append(r.dst)
    total, n = 0.0, max(len(out), 1)
    for s in out:
        order, before, paths, depth = [], {x: [] for x in out}, dict.fromkeys(out, 0), {s: 0}
        paths[s], queue = 1, [s]
        for v in queue:
            order.append(v)
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(out, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
        total += share.get(center, 0.0) if s != center else 0.0
    return total / ((n - 1) * (n - 2)) if n > 2 else 0.0


def centrality(edges: DataFrame, vertices: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per node: in-degree share, PageRank over its maximum, and 0.6 / 0.4 of both, 4 digits."""
    v = vertices.select(F.col("id").alias("node")).distinct()
    n = v.agg(F.count("*").alias("n"), F.lit(1).alias("_k"))
    top = ranks.agg(F.max("rank").alias("top"), F.lit(1).alias("_k"))
    deg = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d"))
    out = v.join(deg, "node", "left").join(ranks, "node", "left").withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").join(F.broadcast(top), "_k")
    share = F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    pr = F.when((F.col("n") > 1) & (F.col("top") > 0), F.coalesce("rank", F.lit(0.0)) / F.col("top")).otherwise(F.lit(0.0))
    return out.select("node", F.round(share, 4).alias("in_degree"), F.round(pr, 4).alias("pagerank"), F.round(0.6 * share + 0.4 * pr, 4).alias("composite"))


def graph_summary(vertices: DataFrame, edge_log: DataFrame) -> DataFrame:
    """(kind, type, n): counts by type; edges count as often as they were added."""
    return (
        vertices.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
        .unionByName(edge_log.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))
    )


def file_commits(edges: DataFrame, commits: DataFrame, file_id: str, limit: int = 50) -> DataFrame:
    e = edges.where((F.col("edge_type") == "CHANGED_IN") & (F.col("src") == file_id)).select(F.col("dst").alias("id"))
    return commits.join(e, "id").orderBy(F.desc("author_date"), "id").limit(limit)


def commit_files(edges: DataFrame, commit_prefix: str) -> DataFrame:
    return edges.where((F.col("edge_type") == "CHANGED_IN") & F.startswith("dst", F.lit(f"commit:{commit_prefix}"))).select(F.col("src").alias("id"), "dst").orderBy("id")
