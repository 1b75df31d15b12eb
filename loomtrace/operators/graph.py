"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.skew import join_heavy
from loomtrace.runtime import discard, materialise, ship_package

MAX_ROUNDS = 60
TASK_EDGES = 500_000


def least_reachable(a, b):
    """(nodes, least node reachable from each) of the undirected edges a - b, two arrays of integers."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while True:
        # Hang the larger root of every edge on the smaller one, then let every node point at its root.
        x, y = low[a], low[b]
        if (x == y).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := low[low], low):
            low = up


def least_forest(i, j, d):
    """(i, j, d) of the least spanning forest of edges i < j, equal ones by i and j. Boruvka's rounds over arrays."""
    import numpy as np

    order = np.lexsort((j, i, d))
    i, j, d = i[order], j[order], d[order]
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    home, left, taken = np.arange(len(nodes)), np.arange(len(i)), np.zeros(len(i), bool)
    while True:
        x, y = home[a[left]], home[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return i[taken], j[taken], d[taken]
        best = np.full(len(nodes), len(i))
        best[x[::-1]] = left[::-1]  # the first edge of each, as edges are in order
        other = np.full(len(nodes), len(i))
        other[y[::-1]] = left[::-1]
        best = np.minimum(best, other)
        new = np.unique(best[best < len(i)])
        taken[new] = True
        roots, low = least_reachable(home[a[new]], home[b[new]])
        to = np.arange(len(nodes))
        to[roots] = low
        home = to[home]


def dense_forest(rows, columns, d):
    """The same of a matrix of distances between ``rows`` and ``columns`` (ascending numbers); infinite ones are no edges. d is overwritten."""
    import numpy as np

    nodes = np.union1d(rows, columns)
    x, y = np.searchsorted(nodes, rows), np.searchsorted(nodes, columns)
    home, found = np.arange(len(nodes)), []
    while d.size:
        # Among equal distances the first of a row or column is also the first by (i, j).
        across, down = d.argmin(1), d.argmin(0)
        a, b = np.concatenate([x, x[down]]), np.concatenate([y[across], y])
        w = np.concatenate([d[np.arange(len(x)), across], d[down, np.arange(len(y))]])
        own = home[np.concatenate([x, y])]
        kept = np.isfinite(w)
        a, b, w, own = a[kept], b[kept], w[kept], own[kept]
        if not len(w):
            break
        i, j = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((j, i, w, own))
        first = order[np.unique(own[order], return_index=True)[1]]
        pairs = np.unique(np.stack([i[first], j[first]]), axis=1)
        found.append((i[first], j[first], w[first]))
        roots, low = least_reachable(home[pairs[0]], home[pairs[1]])
        to = np.arange(len(nodes))
        to[roots] = low
        home = to[home]
        d[home[x][:, None] == home[y][None, :]] = np.inf
    if not found:
        return nodes[:0], nodes[:0], np.zeros(0)
    i, j, w = (np.concatenate(f) for f in zip(*found, strict=True))
    first = np.unique(i * len(nodes) + j, return_index=True)[1]
    return nodes[i[first]], nodes[j[first]], w[first]


def _forest_of_each(edges: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, waiting = [], 0
        for x in batches:
            held.append(tuple(x.column(c).to_numpy() for c in ("i", "j", "d")))
            waiting += x.num_rows
            if waiting > TASK_EDGES:
                held, waiting = [least_forest(*(np.concatenate(f) for f in zip(*held, strict=True)))], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in least_forest(*(np.concatenate(f) for f in zip(*held, strict=True)))], names=["i", "j", "d"])

    ship_package(edges.sparkSession)
    return edges.select("i", "j", "d").mapInArrow(run, "i long, j long, d double")


def joined_forest(edges: DataFrame) -> DataFrame:
    """The least spanning forest of finite edges (i, j, d), i < j: each task leaves its own, and one task joins those.

    The tasks' forests are written before: without that the one task would work out the edges too."""
    parts = materialise(_forest_of_each(edges), "forests", compression="zstd")
    return materialise(_forest_of_each(parts.coalesce(1)), "forest")


def _one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches if x.num_rows]
        if held:
            nodes, low = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(low, pa.int64())], names=["node", "component"])

    ship_package(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of an undirected edge table (src, dst); component is the least node.

    Alternating large-star and small-star rounds: each replaces edges so that nodes hang on the least
    neighbour they know of, until nothing changes. Rounds grow with the logarithm of a component's
    size. Only minima are aggregated (map-side), hubs are joined by broadcast so that their edges never meet
    in one task, and each round is written to the shared folder. As soon as no more than ``task_edges``
    distinct edges (of whole numbers) are left, counted each round, one task finishes them. Null ends are ignored.
    """
    work = materialise(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null and v is not null and src is not null and dst is not null").distinct(),
        "edges",
    )
    loops = work.where("u = v").select("u")
    work_edges, seen = work.where("u <> v"), None
    whole = all(f.dataType.typeName() in ("long", "integer", "short", "byte") for f in work.schema)
    left = work_edges.count()
    for k in range(max_rounds):
        if whole and left <= task_edges:
            alone = loops.select(F.col("u").cast("long").alias("node"), F.col("u").cast("long").alias("component"))
            held = _one_task(work_edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))).unionByName(alone)
            return held.groupBy("node").agg(F.min("component").alias("component"))
        # Large star: every larger neighbour of a node, and the node itself, point at its least neighbour.
        both = work_edges.unionByName(work_edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"least-{k}")
        large = join_heavy(both, least, ["u"], 2 * left).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), f"large-{k}")
        # Small star: the smaller neighbours of a node, and the node itself, point at the least of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"low-{k}")
        small = join_heavy(large, low, ["u"], left).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialise(small.distinct(), f"stars-{k}")
        sums = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("u").cast("decimal(38,0)")).alias("s"), F.sum(F.col("v").cast("decimal(38,0)")).alias("t")).first()
        discard(least, large, low)
        state, left = tuple(sums), sums["n"]
        if k:
            discard(work_edges)
        work_edges = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work_edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    out = work_edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
