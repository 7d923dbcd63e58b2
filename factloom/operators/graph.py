"""Graph operators: closure, components, rings, reachability, clusters.

Loops over joins work at any size.  Graphs whose edge count is checked to be at
most LOCAL_EDGES take a shorter way: one bounded task that runs the sequential
algorithm.  Both give the same result.  Only the clustering is for bounded graphs
by its own law, and says so in its outcome.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import settle

LOCAL_EDGES = 200_000
#: Limits of the clustering and the words of its outcome. Fixed values.
CLUSTER_NODES, CLUSTER_EDGES = 10_000, 130_000
EMPTY, ONE_REGION, ALL_LONE = "empty", "none (single region)", "trivial (all singletons)"


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of all paths of at least one edge, by doubling."""
    reach = settle(edges.select("src", "dst").distinct())
    count = reach.count()
    for _ in range(max_rounds):
        onward = reach.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        reach = settle(reach.unionByName(reach.join(onward, "dst").select("src", F.col("far").alias("dst"))).distinct())
        now = reach.count()
        if now == count:
            return reach
        count = now
    raise RuntimeError("closure did not settle")


def induced(edges: DataFrame, group: DataFrame) -> DataFrame:
    """The edges with both ends among ``group`` (node)."""
    return edges.join(group.select(F.col("node").alias("src")), "src", "left_semi").join(group.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


# bounded local algorithms ---------------------------------------------------


def _adjacency(pairs) -> dict[str, list[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return {k: sorted(v) for k, v in out.items()}


def tarjan(pairs) -> list[list[str]]:
    """Strongly connected components of more than one node, sorted; no recursion."""
    out = _adjacency(pairs)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    found = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        held.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1:
                        found.append(sorted(part))
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                held.add(nxt)
                work.append((nxt, iter(out.get(nxt, ()))))
            elif nxt in held:
                low[node] = min(low[node], index[nxt])
    return sorted(found)


def ring_of(part: list[str], pairs) -> list[str]:
    """From the smallest node always to the smallest successor inside, until a node repeats; that segment, closed."""
    inside = set(part)
    nxt = {}
    for a, b in pairs:
        if a in inside and b in inside and a != b:
            nxt[a] = min(nxt.get(a, b), b)
    at, seen, path = min(part), {}, []
    while at not in seen:
        seen[at] = len(path)
        path.append(at)
        at = nxt[at]
    return [*path[seen[at] :], at]


def shortest_path(pairs, start: str, goal: str) -> list[str] | None:
    """Breadth first; of several, the one found first from sorted successors."""
    out, parent, queue = _adjacency(pairs), {start: None}, deque([start])
    while queue:
        node = queue.popleft()
        for nxt in out.get(node, ()):
            if nxt == goal:
                path = [goal]
                while node is not None:
                    path.append(node)
                    node = parent[node]
                return path[::-1]
            if nxt not in parent:
                parent[nxt] = node
                queue.append(nxt)
    return None


def simple_ring(nodes: list[str], out: dict[str, list[str]]) -> list[str] | None:
    """The first simple ring through the smallest node, depth first in sorted order."""
    start, inside = min(nodes), set(nodes)
    path, on = [start], {start}
    work = [iter(out.get(start, ()))]
    while work:
        nxt = next(work[-1], None)
        if nxt is None:
            work.pop()
            on.discard(path.pop())
        elif nxt == start and len(path) > 1:
            return [*path, start]
        elif nxt in inside and nxt not in on:
            path.append(nxt)
            on.add(nxt)
            work.append(iter(out.get(nxt, ())))
    return None


def cluster_labels(nodes: list[str], pairs: list[tuple[str, str, int]]) -> dict[str, str]:
    """Greedy modularity in integers: merge the pair with the largest k * 2W - K_a * K_b while it is positive.

    An edge from a node to itself counts nowhere.  Ties take the smallest pair of
    names; a cluster is named by its smallest node.
    """
    links: dict[str, dict[str, int]] = {n: {} for n in nodes}
    degree = dict.fromkeys(nodes, 0)
    total = 0
    for a, b, n in pairs:
        if a != b:
            degree[a] += n
            degree[b] += n
            total += n
            links[a][b] = links[a].get(b, 0) + n
            links[b][a] = links[b].get(a, 0) + n
    member = {n: [n] for n in nodes}
    while True:
        best = None
        for a, near in links.items():
            for b, k in near.items():
                if a < b and (gain := k * 2 * total - degree[a] * degree[b]) > 0 and (best is None or (-gain, a, b) < best):
                    best = (-gain, a, b)
        if best is None:
            break
        _, a, b = best
        member[a] += member.pop(b)
        degree[a] += degree.pop(b)
        for c, k in links.pop(b).items():
            del links[c][b]
            if c != a:
                links[a][c] = links[a].get(c, 0) + k
                links[c][a] = links[a][c]
    return {n: k for k, c in member.items() for n in c}


# plans ----------------------------------------------------------------------


def _locally(edges: DataFrame, run, schema: str, group: str | None = None) -> DataFrame:
    """Run a sequential algorithm on each group of edges in a task of its own; the caller checks their size."""
    held = edges if group else edges.withColumn("_one", F.lit(0))
    return held.groupBy(group or "_one").applyInArrow(run, schema)


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for nodes on a cycle of more than one node; component is the smallest of them."""
    edges = settle(edges.select("src", "dst").where("src <> dst").distinct())
    if edges.count() > local_edges:
        return _coloured_components(edges)

    def run(table: pa.Table) -> pa.Table:
        parts = tarjan(zip(table.column("src").to_pylist(), table.column("dst").to_pylist()))
        rows = [(n, p[0]) for p in parts for n in p]
        return pa.table([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["node", "component"])

    return _locally(edges, run, "node string, component string")


def _coloured_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Forward colours, then backward confirmation from each colour's root, on what is left of the graph."""
    done = None
    for _ in range(max_rounds):
        # nodes without an edge in or out are on no cycle
        while True:
            live = edges.select(F.col("src").alias("n")).intersect(edges.select(F.col("dst").alias("n")))
            live = live.select(F.col("n").alias("node"))
            less = settle(induced(edges, live))
            if less.count() == edges.count():
                break
            edges = less
        if edges.isEmpty():
            break
        colour = settle(edges.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            offered = edges.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("c"))
            nxt = settle(colour.join(offered, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour")))
            if nxt.join(colour, ["node", "colour"], "left_anti").isEmpty():
                break
            colour = nxt
        inside = edges.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        back = settle(colour.where("node = colour"))
        front = back
        while True:
            more = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(back, ["node", "colour"], "left_anti")
            front = settle(more)
            if front.isEmpty():
                break
            back = settle(back.unionByName(front))
        done = back if done is None else settle(done.unionByName(back))
        left = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().join(back, "node", "left_anti")
        edges = settle(induced(edges, left))
    spark = edges.sparkSession
    if done is None:
        return spark.createDataFrame([], "node string, component string")
    large = done.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return done.join(large, "colour").select("node", "component")


def rings(edges: DataFrame, components: DataFrame, local_nodes: int = LOCAL_EDGES) -> DataFrame:
    """(component, ring): the representative cycle of each component, as an array that ends where it begins.

    Only the smallest successor of each node is carried on: one row a node.  A
    component of at most ``local_nodes`` nodes is walked in a task of its own,
    others by joins that double the steps of their walks.
    """
    a, b = components.toDF("src", "c"), components.toDF("dst", "c2")
    nxt = settle(edges.where("src <> dst").join(a, "src").join(b, "dst").where("c = c2").groupBy("c", "src").agg(F.min("dst").alias("dst")))
    large = settle(nxt.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > local_nodes).select("c"))

    def run(table: pa.Table) -> pa.Table:
        pairs = [*zip(table.column("src").to_pylist(), table.column("dst").to_pylist())]
        ring = ring_of([a for a, _ in pairs], pairs)
        return pa.table([pa.array([table.column("c")[0].as_py()]), pa.array([ring], pa.list_(pa.string()))], names=["component", "ring"])

    out = _locally(nxt.join(large, "c", "left_anti").select("c", "src", "dst"), run, "component string, ring array<string>", "c")
    return out if large.isEmpty() else out.unionByName(_walked_rings(nxt.join(large, "c", "left_semi")))


def _walked_rings(nxt: DataFrame) -> DataFrame:
    """rings() of successors (c, src, dst), by doubling.

    After 2 ** k steps, more than there are nodes, each walk is on its ring; the
    ring's nodes are those that another walk of so many steps, from the node
    where the smallest node's walk stands, comes by; their order is the number
    of steps to them.
    """
    hop = settle(nxt.select("c", "src", "dst"))
    most = hop.groupBy("c").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    # far: where 2 ** k steps lead; seen: (start, node, steps) of the walk from each component's smallest node
    start = hop.groupBy("c").agg(F.min("src").alias("node"))
    seen, far, k = settle(start.withColumn("steps", F.lit(0).cast("long"))), hop, 0
    while 1 << k <= 2 * most:
        moved = seen.join(far.select("c", F.col("src").alias("node"), "dst"), ["c", "node"]).select("c", F.col("dst").alias("node"), (F.col("steps") + (1 << k)).alias("steps"))
        seen = settle(seen.unionByName(moved))
        far = settle(far.join(far.select("c", F.col("src").alias("dst"), F.col("dst").alias("to")), ["c", "dst"]).select("c", "src", F.col("to").alias("dst")))
        k += 1
    # a node that the walk comes by twice is on the ring; its first visits are the ring in order
    twice = seen.groupBy("c", "node").agg(F.min("steps").alias("first"), F.count("*").alias("visits")).where("visits > 1")
    ordered = twice.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("first", "node"))).alias("r"))
    nodes = F.transform("r", lambda x: x["node"])
    return ordered.select(F.col("c").alias("component"), F.concat(nodes, F.slice(nodes, 1, 1)).alias("ring"))


def paths_from(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node, level, path): nodes reachable from each of ``starts`` (start), with the path that a breadth-first
    queue of sorted successors finds.  A start is reached by itself, at level 0, and never again.

    Of the parents in the level before, the one that entered the queue first
    wins: ranks in the queue follow (parent's rank, name).
    """
    edges = settle(edges.select("src", "dst").where("src <> dst").distinct())
    front = settle(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("level"), F.array(F.lit(0)).alias("rank"), F.array("start").alias("path")))
    seen = front
    for level in range(1, max_rounds):
        step = edges.join(front.select("start", F.col("node").alias("src"), "rank", "path"), "src").join(seen.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti")
        best = step.groupBy("start", "dst").agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("up"))
        # names are ranked inside each parent's turn
        ranked = best.selectExpr("start", "dst as node", f"{level} as level", "concat(up, array(cast(row_number() over (partition by start, up order by dst) as int))) as rank", "concat(path, array(dst)) as path")
        front = settle(ranked)
        if front.isEmpty():
            return seen.select("start", "node", "level", "path")
        seen = settle(seen.unionByName(front))
    raise RuntimeError("reachability did not settle")


def reach_levels(edges: DataFrame, start: str, max_rounds: int = 1000) -> DataFrame:
    """(node, level, path) of paths_from one start."""
    return paths_from(edges, edges.sparkSession.createDataFrame([(start,)], "start string"), max_rounds).select("node", "level", "path")


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight): how many directed edges join two nodes; each row counts, none is dropped."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def _cluster_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int, int]:
    weights = settle(undirected_weights(edges.where("src <> dst")))
    return weights, nodes.count(), weights.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def _skip(nodes: int, edges: int) -> str | None:
    if nodes > CLUSTER_NODES:
        return f"skipped (nodes={nodes} > cap {CLUSTER_NODES})"
    return f"skipped (edges={edges} > cap {CLUSTER_EDGES})" if edges > CLUSTER_EDGES else None


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster): each node with the smallest node of its cluster.

    Directed edges count once each, whatever their direction; an edge from a node
    to itself does not count.  There is no row where nothing was clustered: see
    cluster_outcome for why.  ``nodes`` (node) holds every end of an edge.
    """
    weights, n, w = _cluster_edges(nodes, edges)
    if _skip(n, w) or not w:
        return nodes.sparkSession.createDataFrame([], "node string, cluster string")
    lone = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("weight"))

    def run(table: pa.Table) -> pa.Table:
        rows = [*zip(*(table.column(c).to_pylist() for c in ("a", "b", "weight")))]
        labels = cluster_labels(sorted({x for r in rows for x in r[:2]}), [r for r in rows if r[2]])
        return pa.table([pa.array([*labels], pa.string()), pa.array([*labels.values()], pa.string())], names=["node", "cluster"])

    return _locally(weights.unionByName(lone), run, "node string, cluster string")


def cluster_outcome(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row (nodes, edges, label): what the clustering came to, or which limit it was skipped for."""
    _, n, w = _cluster_edges(nodes, edges)
    label = _skip(n, w) or (EMPTY if not n or not w else None)
    if label is None:
        parts = (clusters(nodes, edges) if found is None else found).select("cluster").distinct().count()
        label = ONE_REGION if parts == 1 and n > 1 else ALL_LONE if parts == n else f"{parts} clusters"
    return nodes.sparkSession.createDataFrame([(n, w, label)], "nodes long, edges long, label string")


def laundered(pairs: DataFrame, fallback: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(src, dst, via): forbidden pairs without an edge of their own, whose source leaves by a fallback hop that leads on to the target.

    The hop is one of the banned claim's own; what other claims on the way do is
    for their own bans.  ``via`` is what lies between on the first shortest path.
    """
    direct = pairs.select("src", "dst").distinct()
    bans = settle(forbidden.select("src", "dst").distinct().join(direct, ["src", "dst"], "left_anti"))
    hops = fallback.select("src", F.col("dst").alias("hop")).distinct().join(bans, "src")
    reach = settle(paths_from(direct, bans.select(F.col("src").alias("start")).unionByName(hops.select(F.col("hop").alias("start")))))
    rides = hops.join(reach.select(F.col("start").alias("hop"), F.col("node").alias("dst")), ["hop", "dst"]).select("src", "dst").distinct()
    whole = reach.where("level > 0").select(F.col("start").alias("src"), F.col("node").alias("dst"), "path")
    return rides.join(whole, ["src", "dst"]).select("src", "dst", F.array_join(F.slice("path", 2, F.size("path") - 2), " -> ").alias("via"))
