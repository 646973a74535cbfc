"""Communities of a weighted graph by the Leiden method, as rounds of joins and aggregates.

Nodes move in batches that cannot harm each other: in a round a community either gives nodes or
takes them, as its strongest wanted move says, and a node moves only if its gain stays positive
after all stronger moves into the same target and out of the same source.  So the quality never
falls, and the strongest wanted move is always made.  Communities are then refined from single nodes
inside them, the refined ones become the nodes of a smaller graph, and the parts of the next level
start from the communities.  Weights are summed as whole numbers, so that reruns agree.

Groups of nodes with few edges are settled inside tasks, by the same rounds: a node moves only between
communities that lie whole in its group, so the gains are exact there and no group hinders another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, staged
from .components import connected_components

#: Weights are rounded to this part of 1; gains below LEAST_GAIN of the same scale count as none
SCALE, LEAST_GAIN = 1_000_000, 0.5
#: Moves into or out of one community that a round looks at; the others wait for the next one
AT_ONCE = 20_000
#: Ends of edges of a group up to which it is settled inside a task (at most ``AT_ONCE``); rows of groups taken at once; rows of a partition
TASK_EDGES, TASK_ROWS, PART_ROWS = 20_000, 400_000, 2_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions of edges (a, b, w); repeated ones add up, loops and weights of 0 or less go."""
    ends = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("u"), F.greatest("a", "b").cast("long").alias("v"), F.round(F.col("w") * SCALE).cast("long").alias("w"))
    once = ends.groupBy("u", "v").agg(F.sum("w").alias("w")).where("w > 0")
    return once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def modularity(edges: DataFrame, assigned: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row (communities, modularity) of a partition (node, community) of a graph (a, b, w).

    Every node with an edge needs a community.  A graph without edges has modularity 0.
    """
    links = both_ways(edges)
    side = lambda c, name: assigned.select(F.col("node").alias(c), F.col("community").alias(name))
    named = links.join(side("u", "c"), "u").join(side("v", "d"), "v")
    each = named.groupBy("c").agg(F.sum("w").alias("total"), F.coalesce(F.sum(F.when(F.col("c") == F.col("d"), F.col("w"))), F.lit(0)).alias("inside"))
    whole = each.agg(F.sum("total").alias("all"))
    share = F.col("inside") / F.col("all") - gamma * (F.col("total") / F.col("all")) * (F.col("total") / F.col("all"))
    value = each.join(F.broadcast(whole), how="cross").agg(F.round(F.coalesce(F.sum(share), F.lit(0.0)), 6).alias("modularity"))
    return assigned.agg(F.count_distinct("community").alias("communities")).join(F.broadcast(value), how="cross")


def _wanted(nodes: DataFrame, links: DataFrame, pull: float, alone: bool) -> DataFrame:
    """(node, k, from, to, gain, first) of the nodes (node, k, c) that gain by a move; ``alone``: of single ones only."""
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    own = nodes.select("node", "k", "c").join(totals, "c").select("node", "k", F.col("c").alias("from"), "total", "n")
    ends = own.select(F.col("node").alias("v"), F.col("from").alias("to"), F.col("total").alias("total_to"))
    # one shuffle by node serves both sums and the join
    near = links.join(ends, "v").select(F.col("u").alias("node"), "to", "total_to", "w").repartition("node")
    tied = near.groupBy("node", "to").agg(F.sum("w").alias("e"), F.max("total_to").alias("total_to")).join(own, "node")
    stays = F.col("to") == F.col("from")
    value = F.col("e") - pull * F.col("k") * F.col("total_to")
    best = F.max(F.when(~stays, F.struct(value.alias("value"), (-F.col("to")).alias("less"))))
    bound = F.max(F.when(stays, F.col("e")))
    found = tied.groupBy("node", "k", "from", "total", "n").agg(best.alias("best"), bound.alias("e")).where("best is not null")
    found = found.where("n = 1") if alone else found
    stay = F.coalesce("e", F.lit(0)) - pull * F.col("k") * (F.col("total") - F.col("k"))
    found = found.select("node", "k", "from", (-F.col("best.less")).alias("to"), (F.col("best.value") - stay).alias("gain")).where(F.col("gain") > LEAST_GAIN)
    return found.withColumn("first", F.struct("gain", F.xxhash64("node").alias("h"), "node"))


def _accepted(wanted: DataFrame, pull: float) -> DataFrame:
    """(node, to): moves whose gains add up at least to what is left of them after the stronger ones."""
    ends = wanted.select(F.col("to").alias("c"), F.col("first").alias("into"), F.lit(None).cast(wanted.schema["first"].dataType).alias("out"))
    ends = ends.unionByName(wanted.select(F.col("from").alias("c"), F.lit(None).cast(wanted.schema["first"].dataType).alias("into"), F.col("first").alias("out")))
    roles = ends.groupBy("c").agg(F.max("into").alias("into"), F.max("out").alias("out"))
    taking = roles.select("c", (F.col("out").isNull() | (F.col("into") > F.col("out"))).alias("takes")).where("takes is not null")
    moves = wanted.join(taking.where("takes").select(F.col("c").alias("to")), "to", "left_semi")
    moves = moves.join(taking.where("takes").select(F.col("c").alias("from")), "from", "left_anti")
    for end in ("to", "from"):
        place = Window.partitionBy(end).orderBy(F.desc("first"))
        moves = moves.withColumn(f"rank_{end}", F.row_number().over(place)).where(F.col(f"rank_{end}") <= AT_ONCE)
        moves = moves.withColumn(f"before_{end}", F.coalesce(F.sum("k").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.col("gain") - pull * F.col("k") * (F.col("before_to") + F.col("before_from"))
    return moves.where(left > LEAST_GAIN).select("node", "to")


def _moved(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    kept = [c for c in nodes.columns if c != "c"]
    return nodes.join(accepted, "node", "left").select(*kept, F.coalesce("to", "c").alias("c"))


def _moves(nodes: DataFrame, links: DataFrame, pull: float, alone: bool = False) -> tuple[DataFrame, bool]:
    """``nodes`` after rounds of moves, until none gains, and whether there was any."""
    any_move = False
    while True:
        wanted = staged(_wanted(nodes, links, pull, alone), "wanted")
        if wanted.isEmpty():
            discard(wanted)
            return nodes, any_move
        after = staged(_moved(nodes, _accepted(wanted, pull)), "nodes")
        discard(nodes, wanted)
        nodes, any_move = after, True


def local_moves(nodes: DataFrame, links: DataFrame, pull: float) -> tuple[DataFrame, bool]:
    """Nodes (node, k, c) after moves between communities that raise the quality, and whether there were any."""
    return _moves(nodes, links, pull)


def refined(nodes: DataFrame, links: DataFrame, pull: float) -> DataFrame:
    """(node, k, p, c): parts ``c`` inside each community ``p`` of (node, k, c), each held together by edges.

    Every node starts alone; single nodes join the part of their community that gains most.  A part
    never gives up a node, so it stays connected.
    """
    few, many = _by_edges(nodes.withColumnRenamed("c", "p"), "p")
    found = _inside(few, links, lambda *group: _rounds(*group, pull, True))
    parts = nodes.select("node", "k", "deg", F.col("c").alias("p")).join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = staged(parts.select("node", "k", "deg", "p", "c"), "parts")
    if many is None:
        return parts
    side = lambda c, name: many.select(F.col("node").alias(c), F.col("p").alias(name))
    inside = staged(links.join(side("u", "p"), "u").join(side("v", "q"), "v").where("p = q").select("u", "v", "w"), "inside")
    large, _ = _moves(staged(parts.join(many.select("node"), "node", "left_semi"), "parts"), inside, pull, alone=True)
    out = staged(parts.join(many.select("node"), "node", "left_anti").unionByName(large), "parts")
    discard(parts, large, inside)
    return out


def _by_edges(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The nodes (node, k, deg, key) of groups with few edges, as (node, k, g), and the other nodes, if there are any."""
    large = staged(nodes.groupBy(key).agg(F.sum("deg").alias("d")).where(F.col("d") > TASK_EDGES).select(key), "large")
    if large.isEmpty():
        return nodes.select("node", "k", F.col(key).alias("g")), None
    return nodes.join(large, key, "left_anti").select("node", "k", F.col(key).alias("g")), nodes.join(large, key, "left_semi")


def _inside(groups: DataFrame, links: DataFrame, settle: Callable) -> DataFrame:
    """(node, c) of the nodes with an edge inside their group (node, k, g), as ``settle`` says; groups are small.

    ``settle`` takes, for several groups at once, the group of each edge, its ends as places among the
    sorted nodes, its weight, the sorted nodes and their k, and returns the place that names the
    community of each node.
    """
    ends = groups.select(F.col("node").alias("u"), "k", "g"), groups.select(F.col("node").alias("v"), F.col("g").alias("h"))
    rows = links.join(ends[0], "u").join(ends[1], "v").where("g = h").select("g", "u", "v", "w", "k")
    parts = max(8, -(-links.count() // PART_ROWS))

    def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell = pa.Table.from_batches(tables)
        g, u, v, w, k = (cell[c].to_numpy() for c in ("g", "u", "v", "w", "k"))
        nodes, at, place = np.unique(u, return_index=True, return_inverse=True)
        c = settle(g, place, np.searchsorted(nodes, v), w, nodes, k[at])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[c])], ["node", "c"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch["g"].to_numpy()
            if n >= TASK_ROWS:
                cut = int(np.searchsorted(g, held[-1]["g"][-1].as_py(), "right"))  # where the last group ends
                held.append(batch.slice(0, cut))
                if cut == len(g):
                    continue
                yield solve(held)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield solve(held)

    return rows.repartition(parts, "g").sortWithinPartitions("g", "u", "v").mapInArrow(meet, "node long, c long")


def _rounds(g: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, nodes: np.ndarray, k: np.ndarray, pull: float, alone: bool) -> np.ndarray:
    """The rounds of ``_moves`` for groups ``g`` of edges that share no node, from single nodes, until none gains."""
    n = len(nodes)
    c, h = np.arange(n), _mixed(nodes)
    while len(u):
        total, size = np.zeros(n, np.int64), np.bincount(c, minlength=n)
        np.add.at(total, c, k)
        key = u * n + c[v]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        e, (node, to), group = np.add.reduceat(w[order], start), np.divmod(key[start], n), g[order][start]
        stays = to == c[node]
        own = np.zeros(n, np.int64)
        own[node[stays]] = e[stays]
        may = ~stays & (size[c[node]] == 1) if alone else ~stays
        node, to, e, group = node[may], to[may], e[may], group[may]
        value = e - pull * k[node] * total[to]
        order = np.lexsort((to, -value, node))
        order = order[np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))] if len(order) else order
        node, to, value, group = node[order], to[order], value[order], group[order]
        gain = value - (own[node] - pull * k[node] * (total[c[node]] - k[node]))
        may = gain > LEAST_GAIN
        node, to, gain, group = node[may], to[may], gain[may], group[may]
        if not len(node):
            break
        # the strongest wanted moves come first
        order = np.lexsort((-nodes[node], ~h[node], -gain))
        node, to, gain, origin = node[order], to[order], gain[order], c[node[order]]
        into, out = np.full(n, n), np.full(n, n)
        np.minimum.at(into, to, np.arange(len(node)))
        np.minimum.at(out, origin, np.arange(len(node)))
        takes = into < out
        may = takes[to] & ~takes[origin]
        node, to, gain, origin = node[may], to[may], gain[may], origin[may]
        left = gain - pull * k[node] * (_before(to, k[node]) + _before(origin, k[node]))
        c[node[left > LEAST_GAIN]] = to[left > LEAST_GAIN]
        stir = np.isin(g, group)
        g, u, v, w = g[stir], u[stir], v[stir], w[stir]
    return c


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _before(key: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sums of the k of the earlier rows with the same key."""
    order = np.argsort(key, kind="stable")
    sums = np.cumsum(k[order]) - k[order]
    start = np.append(True, key[order][1:] != key[order][:-1])
    out = np.empty(len(k), np.int64)
    out[order] = sums - sums[start][np.cumsum(start) - 1] if len(k) else sums
    return out


def _held(g: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, nodes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    c = np.arange(len(nodes))
    while True:
        low = c.copy()
        np.minimum.at(low, c[u], c[v])  # roots are hooked onto the smallest root beside them
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low[c], c):
            return c
        c = low[c]


def leiden(edges: DataFrame, gamma: float = 1.0, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community) of a graph (a, b, w) with integer nodes; a community has the name of its smallest node.

    The quality is modularity with resolution ``gamma``: weight inside minus ``gamma`` times what
    chance would put there.  Passes over all levels are repeated until no node of the graph wants to
    move.  Every community is connected.  ``nodes`` (node) may add nodes without
    edges, which stay alone; null ends, loops and weights of 0 or less are ignored, repeated edges add
    up, an empty table gives no rows but for those nodes.  Only flags and one sum reach the driver.
    """
    first = staged(both_ways(edges), "links")
    strong = F.max(F.struct("w", (-F.col("v")).alias("less")))
    single = first.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), F.count("*").alias("deg"), strong.alias("strong"))
    single = staged(single.select("node", "k", "deg", F.least("node", -F.col("strong.less")).alias("nest")), "nodes")
    total = single.agg(F.sum("k")).first()[0] or 1
    pull = gamma / total
    # nodes whose strongest neighbour is the same settle together first
    few, _ = _by_edges(single, "nest")
    settled = _inside(few, first, lambda *group: _rounds(*group, pull, False))
    level = staged(single.join(settled, "node", "left").select("node", "k", "deg", F.coalesce("c", "node").alias("c")), "nodes")
    discard(single)
    any_move = not level.where("c <> node").isEmpty()
    level, more = local_moves(level, first, pull)
    any_move = any_move or more
    while any_move:
        final = staged(_levels(level, first, pull), "communities")
        if level.join(final, "node").where("c <> community").isEmpty():  # no community has moved since its nodes were settled
            discard(final)
            break
        again = staged(level.drop("c").join(final.withColumnRenamed("community", "c"), "node"), "nodes")
        discard(level, final)
        level, any_move = local_moves(again, first, pull)
    few, many = _by_edges(level, "c")
    held = _inside(few, first, _held).withColumnRenamed("c", "component")
    if many is not None:
        end = lambda c: many.select(F.col("node").alias(c), F.col("c").alias(f"of_{c}"))
        inside = first.where("u < v").join(end("u"), "u").join(end("v"), "v").where("of_u = of_v")
        held = held.unionByName(connected_components(inside, "u", "v"))
    alone = level.select("node") if nodes is None else level.select("node").unionByName(nodes.select(F.col("node").cast("long")).where("node is not null")).distinct()
    return alone.join(held, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def _levels(level: DataFrame, links: DataFrame, pull: float) -> DataFrame:
    """(node, community): communities of (node, k, c) after moves of refined parts, parts of parts and so on."""
    lowest, lowest_links = level, links
    where = level.select(F.col("node").alias("first"), "node")
    while not level.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        parts = refined(level, links, pull)
        if parts.where("node <> c").isEmpty():
            break  # nothing to contract
        home = parts.select("node", F.col("c").alias("part"))
        after = staged(where.join(home, "node").select("first", F.col("part").alias("node")), "where")
        side = lambda c, name: home.select(F.col("node").alias(c), F.col("part").alias(name))  # noqa: B023, E731
        fewer = links.join(side("u", "x"), "u").join(side("v", "y"), "v").where("x <> y").groupBy(F.col("x").alias("u"), F.col("y").alias("v")).agg(F.sum("w").alias("w"))
        fewer = staged(fewer, "links")
        coarse = staged(parts.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k"), F.sum("deg").alias("deg"), F.min("p").alias("c")), "nodes")
        discard(parts)
        if level is not lowest:
            discard(level, where)
        if links is not lowest_links:
            discard(links)
        where, links = after, fewer
        level, _ = local_moves(coarse, links, pull)
    return where.join(level.select("node", F.col("c").alias("community")), "node").select(F.col("first").alias("node"), "community")
