"""Cycles and blast radius: chains by pointer doubling, bitmaps of changes, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ashlar.operators import graph
from ashlar.operators.graph import blast_bitmaps, blast_radius, blast_sizes, cycle_members

EDGES = "src BIGINT, dst BIGINT"


def ahead_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def reached(out, start):
    seen, todo = set(), list(out.get(start, ()))
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo.extend(out.get(n, ()))
    return seen


def groups_of(edges):
    out = ahead_of(edges)
    reach = {n: reached(out, n) for n in {x for e in edges for x in e}}
    return {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if n in r}


def members(spark, edges):
    return {r["node"]: r["grp"] for r in cycle_members(spark.createDataFrame(edges, EDGES)).collect()}


@pytest.fixture
def rounds(monkeypatch):
    """How often each loop variable was written."""
    seen, state = Counter(), graph.Workspace.state

    def counted(self, df, name, where=None):
        seen[name] += 1
        return state(self, df, name, where)
    monkeypatch.setattr(graph.Workspace, "state", counted)
    return seen


def test_a_numbered_cycle_takes_rounds_by_its_logarithm(spark, rounds):
    n = 5000
    got = members(spark, [(i, (i + 1) % n) for i in range(n)])
    assert got == dict.fromkeys(range(n), 0)
    assert rounds["pointers"] <= 15 and rounds["labels"] == 0


def test_long_chains_between_junctions_take_few_rounds(spark, rounds):
    """Two rings of 600 that share a node, a tail into them and one out, and a ring through a self loop."""
    def ring(start, n):
        return [(start, start * 10 + 1), *((start * 10 + i, start * 10 + i + 1) for i in range(1, n)), (start * 10 + n, start)]
    edges = [*ring(900000, 600), *[(a + (a != 900000) * 10**8, b + (b != 900000) * 10**8) for a, b in ring(900000, 600)]]
    edges += [(i, i + 1) for i in range(10, 300)] + [(300, 900000), (900000, 400), (400, 401), (401, 402)]
    edges += [(7, 7), (7, 8), (8, 9), (9, 7)]
    assert members(spark, edges) == groups_of(edges)
    assert rounds["pointers"] <= 15 and rounds["labels"] <= 8


@pytest.mark.parametrize("seed", [1, 4])
def test_sparse_graphs_with_many_chains(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(120))
    rnd.shuffle(nodes)
    edges = set(zip(nodes, nodes[1:], strict=False)) if seed % 2 else set()
    edges |= {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(20 + 25 * seed)}
    edges |= {(200 + i, 200 + (i + 1) % 9) for i in range(9)} | {(300, 301), (301, 300)}
    assert members(spark, sorted(edges)) == groups_of(edges)


def test_cycles_drop_null_ends_and_repeated_edges(spark):
    assert members(spark, [(1, 2), (2, 1), (1, 2), (None, 3), (3, None), (4, 4), (4, 4)]) == {1: 1, 2: 1, 4: 4}


# -- blast radius --------------------------------------------------------------------------------


def hops_of(edges, seeds):
    back = ahead_of((b, a) for a, b in edges)
    want = {}
    for change in {c for c, _ in seeds}:
        ring = {n for c, n in seeds if c == change}
        hops, hop = dict.fromkeys(ring, 0), 0
        while ring:
            hop += 1
            ring = {up for n in ring for up in back.get(n, ())} - set(hops)
            hops.update(dict.fromkeys(ring, hop))
        want |= {(change, n): h for n, h in hops.items() if h}
    return want


@pytest.fixture(scope="module")
def case():
    """Over 512 changes, so that a node has several rows of bits; a third of the seeds is one change, one node a hub."""
    rnd = random.Random(11)
    edges = {(rnd.randrange(150), rnd.randrange(150)) for _ in range(420)} | {(n, 3) for n in range(0, 150, 2)}
    seeds = {(f"c{i:04}", rnd.randrange(150)) for i in range(700) for _ in range(2)} | {("c0005", n) for n in range(0, 150, 3)}
    return sorted(edges), sorted(seeds)


@pytest.fixture(scope="module")
def frames(spark, case):
    return spark.createDataFrame(case[0], EDGES), spark.createDataFrame(case[1], "change STRING, node BIGINT")


def test_bitmaps_hold_the_least_hops_of_every_change(spark, case, frames):
    want = hops_of(*case)
    names = sorted({c for c, _ in case[1]})
    got = {}
    for r in blast_bitmaps(*frames).collect():
        bits = r["bits"] & (1 << 64) - 1
        assert r["changes"] == bits.bit_count() > 0
        for k in range(64):
            if bits >> k & 1:
                assert (names[64 * r["word"] + k], r["node"]) not in got
                got[names[64 * r["word"] + k], r["node"]] = r["hops"]
    assert got == want


def test_rows_and_sizes_say_the_same(spark, case, frames):
    want = hops_of(*case)
    rows = blast_radius(*frames).collect()
    assert {(r["change"], r["node"]): r["hops"] for r in rows} == want and len(rows) == len(want)
    sizes = {(r["change"], r["hops"]): r["nodes"] for r in blast_sizes(*frames).collect()}
    assert sizes == Counter((c, h) for (c, _), h in want.items())


def test_depth_nulls_and_empty_tables(spark, case, frames):
    edges, seeds = frames
    want = hops_of(*case)
    for depth in (0, 2):
        got = {(r["change"], r["node"]): r["hops"] for r in blast_radius(edges, seeds, depth).collect()}
        assert got == {k: h for k, h in want.items() if h <= depth}
    holed = edges.union(spark.createDataFrame([(None, 1), (1, None)], EDGES))
    more = seeds.union(spark.createDataFrame([(None, 3), ("c0001", None)], seeds.schema))
    assert blast_bitmaps(holed, more).exceptAll(blast_bitmaps(edges, seeds)).isEmpty()
    assert blast_bitmaps(edges, seeds.filter("false")).isEmpty() and blast_sizes(edges.filter("false"), seeds).isEmpty()


def test_only_fresh_bits_travel(spark, rounds):
    """A ring of 12 nodes: as many rounds as hops, and a last one that finds nothing."""
    ring = spark.range(12).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12).alias("dst"))
    got = blast_bitmaps(ring, spark.createDataFrame([("a", 0), ("b", 6)], "change STRING, node BIGINT"))
    assert got.agg(F.sum("changes"), F.max("hops")).first()[:] == (2 * 11, 11) and rounds["reached"] == 13
