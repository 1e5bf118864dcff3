"""Reachability and cycles against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from failscope.operators import graphs as gr


def plain(edges, roots):
    out, after = set(), {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    for r in roots:
        todo, seen = list(after.get(r, ())), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        out |= {(r, n) for n in seen}
    return out


def random_graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.choice([15, 25, 45]))]
    at = 100
    for _ in range(rng.randrange(1, 5)):  # chains between nodes, from none, to none
        n = rng.randrange(1, 20)
        walk = [rng.randrange(30), *range(at, at + n), rng.randrange(30)]
        walk = walk[rng.randrange(2) : len(walk) - rng.randrange(2)]
        edges += list(zip(walk, walk[1:]))
        at += n
    loop = list(range(500, 500 + rng.randrange(1, 9)))
    return edges + list(zip(loop, loop[1:] + loop[:1])) + [(900, 900), (901, 901), (901, 3), (None, 1), (2, None), *edges[:2]]


@pytest.mark.parametrize("seed", range(4))
def test_reach_and_cycles_equal_plain_searches(spark, seed):
    edges = random_graph(seed)
    df = spark.createDataFrame(edges, "src int, dst int")
    nodes = sorted({n for e in edges for n in e if n is not None})
    roots = random.Random(seed).sample(nodes, 12) + [500, 900, 12345]
    got = [(r.root, r.node) for r in gr.reach(df, spark.createDataFrame([(r,) for r in roots] + [(None,)], "root int")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(edges, roots)
    every = plain(edges, nodes)
    parts = {r.node: r.component for r in gr.strong_components(df).collect()}
    assert parts.keys() == {a for a, b in every if a == b}
    assert all((parts[a] == parts[b]) == ((a, b) in every and (b, a) in every) for a in parts for b in parts)


def test_nothing(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert gr.cycles(none).count() == 0 and gr.reach(none, spark.createDataFrame([(1,)], "root int")).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    n = 60_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert gr.reach(chain, spark.createDataFrame([(n - 7,)], "root bigint")).count() == 7
    assert gr.cycles(chain).count() == 0
    closed = chain.unionByName(spark.createDataFrame([(n, 50), (10, n + 5)], "src bigint, dst bigint"))
    assert gr.cycles(closed).agg(F.count("node"), F.min("node"), F.max("node")).first() == (n - 49, 50, n)


def test_roles_equal_plain_sets(spark):
    from failscope.operators import causal as cs

    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)] + [(1, 1), (None, 2), (2, None)]
    pairs = [(a, b) for a in range(5) for b in range(4, 12)] + [(3, 3), (0, 4), (77, 1), (None, 1)]
    up, down = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(b, set()).add(a)
            down.setdefault(a, set()).add(b)
    want = set()
    for x, y in pairs:
        for n in set(range(12)) - {x, y}:
            px, cx, py, cy = (n in side.get(end, ()) for end in (x, y) for side in (up, down))
            role = "confounder" if px and py else "collider" if cx and cy else "mediator" if cx and py else "parent" if px else None
            if role:
                want.add((x, y, n, role))
    got = [(r.x, r.y, r.node, r.role) for r in cs.roles(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "x int, y int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # parents of y alone meet no pair: the joins' output is the answer, not each pair's 3,000 neighbours
    hub = spark.createDataFrame([(n, 0) for n in range(100, 3100)] + [(1, 2)], "src int, dst int")
    out = cs.roles(hub, spark.createDataFrame([(x, 0) for x in range(3, 41)], "x int, y int"))
    assert out.collect() == [] and "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_relatives_find_chains_once(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(12)] + [(30, 31), (31, 32), (32, 30)] + [(rng.randrange(20, 28), rng.randrange(28)) for _ in range(25)]
    pairs = [(x, y) for x in (0, 5, 21, 25, 30, 31) for y in (3, 9, 22, 26, 32)]
    after = {n: set() for n in range(33)}
    for a, b in edges:
        after[a].add(b)

    def met(n):
        seen, todo = set(), list(after[n])
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += after[at]
        return seen

    down = {n: met(n) for n in after}
    up = {n: {m for m in after if n in down[m]} for n in after}
    want = {(x, y, k, n) for x, y in pairs for k, both in (("confounder", up[x] & up[y]), ("collider", down[x] & down[y]), ("mediator", down[x] & up[y])) for n in both}
    calls, plain = [], gr.chains
    monkeypatch.setattr(gr, "chains", lambda e: calls.append(1) or plain(e))
    got = [tuple(r) for r in gr.relatives(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "x int, y int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(calls) == 1
