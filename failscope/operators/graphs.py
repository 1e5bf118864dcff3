"""Reachability and cycles of large directed graphs of (src, dst) edges.

Nodes with one edge in and one out are inside chains. Pointers along a chain are doubled until each node knows the chain's
first node and its own place, which takes a number of rounds logarithmic in the length; a chain is then one edge between its
ends. So searches walk over branching nodes alone, and no table of all pairs of nodes is made. Null ends lead nowhere.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import written


class Chains(NamedTuple):
    """A graph whose chains are edges: links (src, dst, chain; null for a plain edge) between branching nodes, nodes inside
    chains (node, chain, pos), and nodes of closed chains (node, loop), which are cycles of their own."""

    links: DataFrame
    inside: DataFrame
    loops: DataFrame


def clean_edges(edges: DataFrame) -> DataFrame:
    """The distinct edges without null ends, written; those that this has made are taken as they are."""
    if getattr(edges, "_failscope_clean", False):
        return edges
    out = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    out._failscope_clean = True
    return out


def chains(edges: DataFrame) -> Chains:
    """The chains of distinct edges."""
    once = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("node")
    both = written(once("src").join(once("dst"), "node"))  # their one edge each way is looked up for these alone
    inner = both.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("prev")), "node").join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node")
    inner = written(inner.select("node", "prev", "next"))
    first = inner.select(F.col("node").alias("prev"), F.lit(True).alias("_on"))
    # to: the node before on the chain, so far; low: the least node passed; a chain's first node is its own
    at = inner.join(first, "prev", "left")
    head = F.col("_on").isNull()
    state = written(at.select("node", F.when(head, F.col("node")).otherwise(F.col("prev")).alias("to"), F.when(head, 0).otherwise(1).cast("bigint").alias("pos"), head.alias("done"), F.when(head, F.col("node")).otherwise(F.least("node", "prev")).alias("low")))
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if state.where("not done").isEmpty():
            break
        far = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("pos").alias("_pos"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        open_ = state.where("not done").join(far, "to")
        moved = open_.select("node", F.col("_to").alias("to"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"))
        state = written(moved.unionByName(state.where("done")))
    loops = state.where("not done").select("node", F.col("low").alias("loop"))  # every node of a loop has passed them all
    inside = state.where("done").select("node", F.col("to").alias("chain"), "pos")
    ends = inside.join(inner, "node").groupBy("chain").agg(F.min_by("prev", "pos").alias("src"), F.max_by("next", "pos").alias("dst"))
    plain = edges.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    kind = edges.schema["src"].dataType
    links = plain.select("src", "dst", F.lit(None).cast(kind).alias("chain")).unionByName(ends.select("src", "dst", "chain"))
    return Chains(written(links), written(inside), written(loops))


def turned(g: Chains) -> Chains:
    """The chains of the flipped edges, from those of the edges."""
    links = g.links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "chain")
    return Chains(links, g.inside.withColumn("pos", -F.col("pos")), g.loops)


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """GR1: (root, node) for all that the roots of ``start`` (column root) reach; a root is there if it reaches itself.

    Rounds go over branching nodes, each written once: a round joins the frontier with the links and leaves out what was met.
    Then chains that were entered add their nodes, and a root inside a chain those behind it.
    """
    return _reached(chains(clean_edges(edges)), start)


def _reached(g: Chains, start: DataFrame) -> DataFrame:
    roots = written(start.select("root").where("root is not null").distinct())
    placed = written(roots.join(g.inside, F.col("root") == F.col("node")).select("root", "chain", F.col("pos").alias("_pos")))
    behind = placed.join(g.inside, "chain").where("pos > _pos").select("root", "node")
    round_ = roots.join(g.loops, F.col("root") == F.col("node")).select("root", "loop").join(g.loops, "loop").select("root", "node")
    tails = placed.join(g.links.select("chain", F.col("dst").alias("node")), "chain").select("root", "node")
    step = lambda f: f.join(g.links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"))
    own = roots.select("root", F.col("root").alias("node"))
    frontier = written(tails.unionByName(step(own)).distinct())
    met = frontier
    while not frontier.isEmpty():
        frontier = written(step(frontier).distinct().join(met, ["root", "node"], "left_anti"))
        met = met.unionByName(frontier)
    entered = met.unionByName(own).join(g.links.where("chain is not null"), F.col("node") == F.col("src")).select("root", "chain").distinct()
    passed = entered.join(g.inside, "chain").select("root", "node")
    # met is distinct and holds no node that is inside a chain or on a closed one
    return met.unionByName(passed.unionByName(behind).unionByName(round_).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle, by their strongly connected components.

    Chains become edges, and edges that no cycle can hold (none enters or none leaves an end) go, until neither helps; what is
    left, where every node branches, is coloured: the largest node that reaches a node is its colour, and what reaches back to
    it within a colour is its component. A chain is in the component that holds both its ends.
    """
    edges = clean_edges(edges)
    n = edges.count()
    if not n:
        return written(edges.select(F.col("src").alias("node"), F.col("src").alias("component")))
    g = chains(edges)
    loops = g.loops.select("node", F.col("loop").alias("component"))
    core = written(_trimmed(g.links.select("src", "dst").distinct()))
    below = strong_components(core) if core.count() < n else _coloured(core)
    a, b = below.select(F.col("node").alias("src"), F.col("component")), below.select(F.col("node").alias("dst"), F.col("component").alias("_c"))
    held = g.links.where("chain is not null").join(a, "src").join(b, "dst").where(F.col("component") == F.col("_c")).select("chain", "component")
    inside = g.inside.join(held, "chain").select("node", "component")
    return written(below.unionByName(inside).unionByName(loops).distinct())


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start is entered and whose end is left."""
    entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")


def _coloured(edges: DataFrame) -> DataFrame:
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")))
        while True:  # colours grow along edges
            sent = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_c"))
            new = written(colour.join(sent, "node", "left").select("node", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("_new")))
            colour = new.select("node", "colour")
            if new.where("_new").isEmpty():
                break
        same = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst")
        same = written(same.where(F.col("_a") == F.col("_b")).select("src", "dst", F.col("_a").alias("component")))
        frontier = written(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        part = frontier
        while not frontier.isEmpty():  # back to the colour's own node
            back = frontier.join(same.withColumnRenamed("dst", "node"), ["node", "component"]).select(F.col("src").alias("node"), "component").distinct()
            frontier = written(back.join(part, "node", "left_anti"))
            part = part.unionByName(frontier)
        part = written(part)
        # a component of one node is on a cycle only if it has an edge to itself
        size = part.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("_own", F.lit(True))
        cyclic = part.join(size, "component").join(alone, "node", "left").where("_n > 1 or _own").select("node", "component")
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = part.select("node")
        rest = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        edges = written(_trimmed(rest.select("src", "dst")))
    return written(found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """GR2: nodes that reach themselves; no row in an acyclic graph."""
    return strong_components(edges).select("node")


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def relatives(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR3–GR5: (x, y, kind, node) for each of the pairs (x, y): confounders (common ancestors), colliders (common
    descendants), mediators (between). Searches start at the nodes of the pairs alone, all at once."""
    edges, pairs = clean_edges(edges), written(pairs.distinct())
    xs, ys = pairs.select(F.col("x").alias("root")).distinct(), pairs.select(F.col("y").alias("root")).distinct()
    start = xs.union(ys).distinct()
    g = chains(edges)
    down, up = written(_reached(g, start)), written(_reached(turned(g), start))
    of = lambda d, roots, c: d.join(roots, "root", "left_semi").withColumnRenamed("root", c)
    kind = lambda a, b, k: of(a, xs, "x").join(of(b, ys, "y"), "node").join(pairs, ["x", "y"]).select("x", "y", F.lit(k).alias("kind"), "node")
    return kind(up, up, "confounder").unionByName(kind(down, down, "collider")).unionByName(kind(down, up, "mediator"))
