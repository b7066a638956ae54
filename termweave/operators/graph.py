"""Graph algorithms on edges (src, dst, weight): components, communities, betweenness.

All iterate over written tables, so that a lost executor costs one step. What reaches the driver are counts and sums.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.network import both_ways, row_numbers
from termweave.session import broadcast_if_small, cut

#: Edges up to which betweenness holds the whole graph in each worker, and up to which one task finds the communities.
HELD_EDGES, ONE_TASK_EDGES = 2_000_000, 4_000_000
#: Rounds of components and turns of communities beyond which something is wrong; least gain of modularity that counts.
MOST_ROUNDS, MOST_TURNS, LEAST_GAIN = 60, 2_000, 1e-9
#: Shares of the rows that hold one label, as a giant component has, in the join of labels.
SALTS = 16


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, component): the least id of each node's component. Labels spread along edges and, by pointer jumping, along
    labels, so the rounds are about logarithmic in the diameter; labels still moving after max_rounds are an error.

    Labels are looked up once each, by copies for SALTS shares of the nodes, so that the nodes of a giant component, which all
    have one label, don't meet in one task."""
    links = cut(both_ways(edges.filter("weight > 0")).select("id", "other"), "links")
    labels = cut(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("id", "other").withColumnRenamed("component", "theirs"), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("theirs", "component")).alias("low"))
        lower = cut(lower, "lower")
        used = lower.select("low").distinct()
        jump = cut(used.join(lower.select(F.col("id").alias("low"), F.col("low").alias("lowest")), "low"), "jump")
        copies = jump.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = lower.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        labels_new = cut(salted.join(copies, ["low", "salt"]).select("id", F.least("low", "lowest").alias("component"), F.col("component").alias("before")), "labels")
        changed = labels_new.filter("component <> before").limit(1).count()
        labels = labels_new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def numbered_components(components: DataFrame) -> DataFrame:
    """(id, cluster): components numbered from 1 by their least id."""
    ids = row_numbers(cut(components.select("component").distinct(), "least"), [F.asc("component")], "cluster")
    return components.join(ids, "component").select("id", "cluster")


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component with most nodes, of equal ones the one with the least id."""
    components = cut(connected_components(nodes, edges), "components")
    best = components.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    ids = components.join(F.broadcast(best), "component").select("id")
    kept = cut(ids, "largest")
    return nodes.join(kept, "id", "left_semi"), edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, cluster): communities of high modularity, numbered from 1, larger ones first, equal ones by their least id.

    The two steps of the Louvain method. In a turn the nodes that gain by it move to the neighbouring community that gains
    most (ties to the lesser one), a share of them chosen by a hash of node and turn; a turn that lowers the modularity is
    undone and a smaller share tried, down to the one node that gains most. When no node gains, communities become the nodes
    of the next level, until none moves there either. A graph of up to one_task edges is one task's work in arrays, a larger
    one is worked on in joins; both go on to the same end. Without edges all nodes are one cluster.
    """
    graph = cut(edges.filter("weight > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")), "graph")
    size, total = graph.agg(F.count("*"), F.sum("weight")).first()
    if not total:
        return nodes.select("id", F.lit(1).cast("bigint").alias("cluster"))
    if size <= one_task:

        def work(batches):
            rows = [pa.Table.from_batches([b]) for b in batches]
            if rows:
                ends = pa.concat_tables(rows)
                ids, community = _communities(*(ends[c].to_numpy() for c in ("src", "dst", "weight")), resolution)
                yield pa.record_batch({"id": pa.array(ids, pa.int64()), "community": pa.array(community, pa.int64())})

        found = graph.repartition(1).mapInArrow(work, "id long, community long")
        member = nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    else:
        member = _communities_by_joins(nodes, graph, float(total), resolution)
    member = cut(member, "member")
    sizes = cut(member.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("least")), "sizes")
    ranked = row_numbers(sizes, [F.desc("size"), F.asc("least")], "cluster")
    return member.join(broadcast_if_small(cut(ranked.select("community", "cluster"), "ranked")), "community").select("id", "cluster")


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """A hash of node and turn."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))


def _communities(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, community of each, named by one of its ids) by local moving and levels."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, w = ends[: len(src)], ends[len(src) :], weight.astype(float)
    m = w.sum()
    member = np.arange(len(ids))
    while True:
        n = int(max(a.max(), b.max())) + 1
        loop = a == b
        x, y, z = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), np.concatenate([w[~loop], w[~loop]])
        k = np.bincount(x, z, n) + 2 * np.bincount(a[loop], w[loop], n)
        c, share, moved = np.arange(n), 1, False

        def quality(c):
            return w[c[a] == c[b]].sum() / m - resolution * ((np.bincount(c, k, n) / (2 * m)) ** 2).sum()

        q = quality(c)
        for turn in range(MOST_TURNS):
            key, at = np.unique(np.concatenate([x * n + c[y], np.arange(n) * n + c]), return_inverse=True)
            near = np.bincount(at, np.concatenate([z, np.zeros(n)]), len(key))
            node, to = key // n, key % n
            own = to == c[node]
            tot = np.bincount(c, k, n)
            gain = near - resolution * k[node] * (tot[to] - own * k[node]) / (2 * m)
            stay = np.zeros(n)
            stay[node[own]] = gain[own]
            order = np.lexsort((to, -gain, node))
            first = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
            best, better = to[first], gain[first] - stay
            wants = np.flatnonzero(better > LEAST_GAIN * m)
            if not len(wants):
                break
            moves = wants[_mixed(wants, turn) >> np.uint64(64 - share) == 0] if share < 20 else wants[:0]
            if not len(moves):
                moves = wants[[better[wants].argmax()]]
            new = c.copy()
            new[moves] = best[moves]
            then = quality(new)
            if then > q:
                c, q, moved, share = new, then, True, max(1, share - 1)
            elif len(moves) == 1:
                break  # a gain within rounding
            else:
                share += 1
        else:
            raise RuntimeError(f"nodes still move after {MOST_TURNS} turns")
        kept, label = np.unique(c, return_inverse=True)
        member = label[member]
        if not moved:
            break
        a, b = label[a], label[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        pair, at = np.unique(low * len(kept) + high, return_inverse=True)
        a, b, w = pair // len(kept), pair % len(kept), np.bincount(at, w)
    least = np.full(int(member.max()) + 1, len(ids))
    np.minimum.at(least, member, np.arange(len(ids)))
    return ids, ids[least[member]]


def _communities_by_joins(nodes: DataFrame, graph: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, community) of a graph too large for one task; its state is written each turn, so a lost executor costs one."""
    member, two_m = nodes.select("id", F.col("id").alias("community")), 2.0 * total
    while True:
        links = cut(both_ways(graph.filter("src <> dst")), "links")
        loops = graph.filter("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("loop"))
        ends = links.groupBy("id").agg(F.sum("weight").alias("k"))
        ids = member.select(F.col("community").alias("id")).distinct()
        state = cut(ids.join(ends, "id", "left").join(loops, "id", "left").select("id", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"), F.col("id").alias("c")), "state")

        def quality(state, graph=graph):
            inner = graph.join(state.select(F.col("id").alias("src"), F.col("c").alias("ca")), "src").join(state.select(F.col("id").alias("dst"), F.col("c").alias("cb")), "dst").filter("ca = cb").agg(F.sum("weight")).first()[0]
            outer = state.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum((F.col("k") / two_m) ** 2)).first()[0]
            return (inner or 0.0) / total - resolution * (outer or 0.0)

        q, share, moved = quality(state), 1, False
        for turn in range(MOST_TURNS):
            weight = state.groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.join(state.select(F.col("id").alias("other"), F.col("c").alias("to")), "other").groupBy("id", "to").agg(F.sum("weight").alias("w"))
            stay = state.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w"))
            offers = near.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w"))
            scored = offers.join(state, "id").join(weight.withColumnRenamed("c", "to"), "to")
            own = F.col("to") == F.col("c")
            gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / two_m
            rated = scored.select("id", "to", own.alias("own"), gain.alias("gain")).groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("neg"))).alias("b"), F.max(F.when(F.col("own"), F.col("gain"))).alias("stay"))
            wants = cut(rated.select("id", (-F.col("b.neg")).alias("to"), (F.col("b.gain") - F.col("stay")).alias("better")).filter(F.col("better") > LEAST_GAIN * total), "wants")
            if wants.isEmpty():
                break
            moves = wants.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << share)) == 0)
            single = share >= 20 or moves.isEmpty()
            moves = wants.orderBy(F.desc("better"), "id").limit(1) if single else moves
            new = cut(state.join(moves.select("id", "to"), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")), "state")
            then = quality(new)
            if then > q:
                state, q, moved, share = new, then, True, max(1, share - 1)
            elif single:
                break  # a gain within rounding
            else:
                share += 1
        else:
            raise RuntimeError(f"nodes still move after {MOST_TURNS} turns")
        label = state.select("id", "c")
        member = cut(member.join(label.withColumnRenamed("id", "community"), "community").select("id", F.col("c").alias("community")), "member")
        if not moved:
            return member
        graph = graph.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        graph = cut(graph.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")


def betweenness(nodes: DataFrame, edges: DataFrame, held_edges: int = HELD_EDGES) -> DataFrame:
    """(id, betweenness): share of shortest paths through each node, a strong link being a short one; 0 without edges.

    Exact: every node is a source, and the sources are spread over the tasks, each of which holds the graph. A graph with
    more than held_edges edges is refused, as it would not fit there; its largest component or a higher threshold may.
    """
    spark = nodes.sparkSession
    graph = cut(edges.filter("weight > 0").select("src", "dst", (1 / F.col("weight")).alias("d")), "graph")
    if graph.count() > held_edges:
        raise ValueError(f"more than {held_edges} edges: raise the threshold or take the largest component")
    rows = [(r[0], r[1], r[2]) for r in graph.toLocalIterator()]
    shared = spark.sparkContext.broadcast(rows)
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0

    def work(batches):
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, d in shared.value:
            near.setdefault(a, []).append((b, d))
            near.setdefault(b, []).append((a, d))
        sums: dict[int, float] = {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for node, share in _dependencies(near, source):
                    sums[node] = sums.get(node, 0.0) + share
        yield pa.record_batch({"id": pa.array(list(sums), pa.int64()), "part": pa.array(list(sums.values()), pa.float64())})

    parts = nodes.select("id").repartition(4 * spark.sparkContext.defaultParallelism, "id").mapInArrow(work, "id long, part double")
    total = parts.groupBy("id").agg(F.sum("part").alias("part"))
    return nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(near: dict, source: int):
    """(node, share) of the shortest paths from source that run through node, by distances and path counts."""
    distance, paths, before, settled, heap = {source: 0.0}, {source: 1.0}, {source: []}, [], [(0.0, source)]
    done = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        settled.append(v)
        for w, length in near.get(v, ()):
            if w in done:
                continue
            new = d + length
            old = distance.get(w)
            if old is None or new < old - 1e-12 * max(1.0, old):
                distance[w], paths[w], before[w] = new, paths[v], [v]
                heapq.heappush(heap, (new, w))
            elif abs(new - old) <= 1e-12 * max(1.0, old):
                paths[w] += paths[v]
                before[w].append(v)
    share = dict.fromkeys(settled, 0.0)
    for w in reversed(settled):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + share[w])
        if w != source and share[w]:
            yield w, share[w]
