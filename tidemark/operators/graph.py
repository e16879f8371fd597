"""Graph operators over edges (src, dst) and nodes (id).

Iterations are joins and aggregates; between rounds the state is written to the shared
folder, which cuts the lineage and survives lost executors; every round is cut, as a round uses the state more than
once and uncut rounds would multiply. Sums per node are combined
before the shuffle, so a hub with a third of all edges is no heavy task; a hub's adjacency
is never collected, except in betweenness and modularity, which say so and bound it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import dropped, written

#: Edges times sources that a task walks at once.
BLOCK = 4_000_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).where("id is not null").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once in either direction, without loops and repeats."""
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, cut_every: int = 1) -> DataFrame:
    """id, rank: power iteration until the summed change is within the tolerance, at most ``rounds`` times.

    Parallel edges count. The mass of nodes without edges is spread evenly; edges to what is no
    node lose theirs. Ranks add up to one if every end of an edge is a node.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(None).cast("double").alias("rank"))
    links = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    links = written(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    base = written(ids.join(links.select(F.col("src").alias("id")).distinct().withColumn("__has", F.lit(True)), "id", "left").select("id", F.col("__has").isNull().alias("dangling")))
    ranks = base.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    for k in range(1, rounds + 1):
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        stepped = ranks.join(given, "id", "left").crossJoin(F.broadcast(loose)).select("id", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        if k % cut_every and k < rounds:
            ranks = stepped.drop("moved")
            continue
        last, stepped = (stepped_last if k > cut_every else None), written(stepped)
        moved = stepped.agg(F.sum("moved").alias("m")).first().m if tolerance > 0 else 1.0
        ranks, stepped_last = stepped.drop("moved"), stepped
        dropped(last)
        if moved <= tolerance:
            break
    return ranks.select("id", "rank")


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, community (from 0): synchronous label propagation on the undirected graph.

    A node takes the commonest label among itself and its neighbours, the smallest on ties, so
    the result is the same everywhere. Ends when nothing changes or after ``rounds``. Isolated
    nodes stay alone. Communities are numbered by their labels.
    """
    links = written(undirected(edges))
    labels = last = written(nodes.select("id").distinct().select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label").union(labels.select("id", "label"))
        counted = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("c"))
        best = counted.groupBy("id").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("label"))
        stepped = written(best.join(labels.withColumnRenamed("label", "old"), "id"))
        changed = stepped.where("label <> old").limit(1).count()
        dropped(last)
        labels, last = stepped.select("id", "label"), stepped
        if not changed:
            break
    from .ranking import global_rank

    numbers = labels.select("label").distinct().withColumn("__h", F.col("label")).withColumn("__z", F.xxhash64("label"))
    numeric = dict(labels.dtypes)["label"] in ("int", "bigint", "smallint", "double")
    ranked = global_rank(numbers, "__h" if numeric else "__z", ["label"], "k").select("label", (F.col("k") - 1).alias("community"))
    return labels.join(ranked, "label").select("id", "community")


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component: the smallest id of each component, by propagation with pointer jumping."""
    links = written(undirected(edges))
    state = last = written(nodes.select("id").distinct().select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        offered = links.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "component")
        least = offered.union(state.select("id", "component")).groupBy("id").agg(F.min("component").alias("c"))
        jumped = least.join(state.select(F.col("id").alias("c"), F.col("component").alias("further")), "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("c"))
        stepped = written(jumped.join(state, "id").select("id", F.col("c").alias("component"), (F.col("c") != F.col("component")).alias("moved")))
        dropped(last)
        state, last = stepped.select("id", "component"), stepped
        if not stepped.where("moved").limit(1).count():
            return state
    raise RuntimeError(f"components still change after {rounds} rounds")


def _adjacency(edges: DataFrame, most_edges: int) -> tuple[list, dict, np.ndarray, np.ndarray]:
    """Compressed rows of the whole graph on the driver, only below a stated size."""
    count = edges.count()
    if count > most_edges:
        raise ValueError(f"{count} edges; exact betweenness and modularity keep at most {most_edges} in memory")
    pdf = edges.toPandas()
    ids = sorted(set(pdf.src) | set(pdf.dst))
    at = {v: i for i, v in enumerate(ids)}
    src, dst = pdf.src.map(at).to_numpy(dtype=np.int64), pdf.dst.map(at).to_numpy(dtype=np.int64)
    order = np.lexsort((dst, src))
    starts = np.searchsorted(src[order], np.arange(len(ids) + 1)) if len(ids) else np.zeros(1, int)
    return ids, at, starts, dst[order]


def _dependencies(starts: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The dependencies of a block of sources on each node, added up: all sources walk outward together, level by level, and back."""
    size = len(starts) - 1
    degree = np.diff(starts)
    places = len(sources) * size  # a place is a source and a node
    origin = np.arange(len(sources)) * size + sources
    seen, paths = np.zeros(places, bool), np.zeros(places)
    seen[origin], paths[origin] = True, 1.0
    front, levels = origin, []
    while len(front):
        at = front % size
        many = degree[at]
        tail = np.repeat(front, many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        head = np.repeat(front - at, many) + to[np.repeat(starts[at], many) + step]
        new = ~seen[head]
        tail, head = tail[new], head[new]
        np.add.at(paths, head, paths[tail])
        front = np.unique(head)
        seen[front] = True
        levels.append((tail, head))
    credit = np.zeros(places)
    for tail, head in reversed(levels):
        np.add.at(credit, tail, paths[tail] / paths[head] * (1 + credit[head]))
    credit[origin] = 0.0
    return credit.reshape(len(sources), size).sum(axis=0)


def betweenness(nodes: DataFrame, edges: DataFrame, directed: bool = False, most_edges: int = 2_000_000) -> DataFrame:
    """id, centrality: exact shortest-path betweenness (Brandes), shared among executors by source.

    The adjacency, bounded by ``most_edges``, goes to every executor; each sums the dependencies
    of its sources, and the sums are added by node. Divided by (n-1)(n-2); isolated nodes are 0.
    """
    links = edges.where("src <> dst").select("src", "dst").distinct() if directed else undirected(edges)
    ids, at, starts, to = _adjacency(links, most_edges)
    spark = nodes.sparkSession
    n = nodes.select("id").distinct().count()
    kind = nodes.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((starts, to))

    block = max(1, BLOCK // max(1, len(to)))

    def dependencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, to = shared.value
        total = np.zeros(len(starts) - 1)
        for batch in batches:
            sources = batch["at"].to_numpy()
            for lo in range(0, len(sources), block):
                total += _dependencies(starts, to, sources[lo : lo + block])
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"at": hit, "sum": total[hit]})

    sources = spark.range(len(ids)).select(F.col("id").alias("at"))
    summed = sources.mapInPandas(dependencies, "at bigint, sum double").groupBy("at").agg(F.sum("sum").alias("sum"))
    names = spark.createDataFrame(list(enumerate(ids)), f"at bigint, id {kind}") if ids else spark.createDataFrame([], f"at bigint, id {kind}")
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return nodes.select("id").distinct().join(names, "id", "left").join(summed, "at", "left").select("id", F.coalesce(F.col("sum") / scale, F.lit(0.0)).alias("centrality"))


def ecosystem_centrality(centrality: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """id, centrality: the mean of a node's own and its most central neighbours' centrality."""
    from pyspark.sql import Window

    links = undirected(edges).join(centrality.select(F.col("id").alias("dst"), F.col("centrality").alias("c")), "dst")
    best = links.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("c"), "dst"))).where(F.col("k") <= top)
    sums = best.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"))
    return centrality.join(sums, "id", "left").select("id", ((F.col("centrality") + F.coalesce("s", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))).alias("centrality"))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6, cut_every: int = 1) -> DataFrame:
    """id, score: power iteration on the undirected graph with the identity added, so it also settles on bipartite graphs; unit length."""
    links = written(undirected(edges))
    state = nodes.select("id").distinct().withColumn("score", F.lit(1.0))
    for k in range(1, rounds + 1):
        got = links.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        raw = state.join(got, "id", "left").select("id", "score", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("new"))
        length = raw.agg(F.sqrt(F.sum(F.col("new") * F.col("new"))).alias("len"))
        stepped = raw.crossJoin(F.broadcast(length)).select("id", F.try_divide("new", "len").alias("new"), "score")
        if k % cut_every and k < rounds:
            state = stepped.select("id", F.col("new").alias("score"))
            continue
        last, stepped = (stepped_last if k > cut_every else None), written(stepped)
        moved = stepped.agg(F.max(F.abs(F.col("new") - F.col("score"))).alias("m")).first().m
        state, stepped_last = stepped.select("id", F.col("new").alias("score")), stepped
        dropped(last)
        if moved is None or moved < tolerance:
            break
    return state


def knowledge_centrality(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, centrality: the mean of directed betweenness and eigenvector score, which may take ``rounds`` to settle."""
    return betweenness(nodes, edges, directed=True).join(eigenvector(nodes, edges, rounds), "id").select("id", ((F.col("centrality") + F.col("score")) / 2).alias("centrality"))


def _louvain(starts: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Communities by greedy moves that raise modularity, level by level; nodes and ties in order of number."""
    n = len(starts) - 1
    weights: list[dict[int, float]] = [dict.fromkeys(to[starts[i] : starts[i + 1]].tolist(), 1.0) for i in range(n)]
    member = np.arange(n)
    while True:
        size = len(weights)
        degree = [sum(w.values()) for w in weights]
        whole = sum(degree) or 1.0
        group, total = list(range(size)), list(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in range(size):
                near: dict[int, float] = defaultdict(float)
                for u, w in weights[v].items():
                    if u != v:
                        near[group[u]] += w
                own = group[v]
                total[own] -= degree[v]
                best, gain = own, near.get(own, 0.0) - degree[v] * total[own] / whole
                for g in sorted(near):
                    new = near[g] - degree[v] * total[g] / whole
                    if new > gain + 1e-12:
                        best, gain = g, new
                total[best] += degree[v]
                if best != own:
                    group[v], moved, moved_any = best, True, True
        names = {g: i for i, g in enumerate(sorted(set(group)))}
        group = [names[g] for g in group]
        member = np.array([group[m] for m in member])
        if not moved_any:
            return member
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        for v in range(size):
            for u, w in weights[v].items():
                merged[group[v]][group[u]] += w
        weights = [dict(m) for m in merged]


def modularity_communities(nodes: DataFrame, edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """id, community (from 0) by modularity, in one task over a graph of at most ``most_edges``; isolated nodes are alone."""
    ids, _, starts, to = _adjacency(undirected(edges), most_edges)
    member = _louvain(starts, to) if ids else []
    spark, kind = nodes.sparkSession, nodes.schema["id"].dataType.simpleString()
    known = spark.createDataFrame([(i, int(m)) for i, m in zip(ids, member, strict=True)], f"id {kind}, community bigint")
    alone = nodes.select("id").distinct().join(known, "id", "left_anti")
    from .ranking import global_rank

    first = int(max(member)) + 1 if len(member) else 0
    numbered = global_rank(alone.withColumn("__h", F.xxhash64("id")), "__h", ["id"], "k").select("id", (F.col("k") - 1 + first).alias("community"))
    return known.unionByName(numbered)


def community_density(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, edges, density: undirected edges inside over those possible; 0 below two members."""
    c = communities.select("id", "community")
    pairs = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = pairs.join(c.select(F.col("id").alias("a"), "community"), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("other")), "b").where("community = other")
    counts = inside.groupBy("community").agg(F.count(F.lit(1)).alias("edges"))
    sizes = c.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    possible = F.col("size") * (F.col("size") - 1) / 2.0
    return sizes.join(counts, "community", "left").select("community", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce(F.when(F.col("size") > 1, F.coalesce("edges", F.lit(0)) / F.nullif(possible, F.lit(0.0))), F.lit(0.0)).alias("density"))


def low_density(densities: DataFrame) -> DataFrame:
    """Communities below the median density."""
    med = densities.agg(F.median("density").alias("__m"))
    return densities.crossJoin(F.broadcast(med)).where(F.col("density") < F.col("__m")).drop("__m")


def members(communities: DataFrame) -> DataFrame:
    """community, members (sorted ids). The list of a community is one value: for communities that fit one."""
    return communities.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))


def crawl(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int | None = 100, visited: DataFrame | None = None) -> DataFrame:
    """id, depth: breadth-first from the seeds up to a depth and a number of nodes (the nearest, then the smallest ids); ``visited`` resumes an earlier run."""
    from .ranking import global_rank

    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    if visited is not None:
        reached = visited.select("id", "depth").unionByName(reached).groupBy("id").agg(F.min("depth").alias("depth"))
    reached = written(reached)
    for level in range(1, depth + 1):
        front = reached.where(F.col("depth") == level - 1)
        new = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).where("id is not null").distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(level))
        new = written(new)
        if new.isEmpty():
            if visited is None:
                break
            continue  # an earlier run may have reached this far
        reached = written(reached.unionByName(new))
    if most is None:
        return reached
    return global_rank(reached, "depth", ["id"], "k").where(F.col("k") <= most).select("id", "depth")


def extend(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with more nodes and those of their edges whose ends are nodes."""
    from .joins import edges_between

    every = nodes.select("id").union(new_nodes.select("id")).distinct()
    return every, edges.unionByName(edges_between(new_edges, every)).distinct()


def counts_by_type(rows: DataFrame, kind: str) -> DataFrame:
    """Nodes or relationships by label or type."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their number of rows; null keys too."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def display_network(centrality: DataFrame, communities: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """The ``most`` central nodes, and pairs of these in the same community (a report of stated size)."""
    best = centrality.orderBy(F.desc("centrality"), "id").limit(most).join(communities, "id")
    a, b = best.select(F.col("id").alias("src"), "community"), best.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    return best, a.join(b, (F.col("community") == F.col("other")) & (F.col("src") < F.col("dst"))).select("src", "dst", "community")


def nodes_by_type(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def neighbours(edges: DataFrame, kind: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """One step of a path: source rows joined over edges of a type to target rows (columns of both, prefixed a_ and b_)."""
    e = edges.where(F.col("type") == kind)
    a = source.select(*(F.col(c).alias(f"a_{c}") for c in source.columns))
    b = target.select(*(F.col(c).alias(f"b_{c}") for c in target.columns))
    return a.join(e, F.col("a_id") == F.col("src")).join(b, F.col("b_id") == F.col("dst")).drop("src", "dst", "type")
