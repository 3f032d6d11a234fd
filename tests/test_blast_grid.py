"""The grid of a blast hop: fewer rows than edges, the same pairs, and no round that finds nothing."""

import random

import pytest

from ashlar.operators import graph
from ashlar.plans.loops import Workspace


def walk(edges, seeds):
    back, found = {}, {}
    for src, dst in edges:
        back.setdefault(dst, set()).add(src)
    for change in {c for c, _ in seeds}:
        front, hops = {n for c, n in seeds if c == change}, 0
        seen = set(front)
        while front:
            hops += 1
            front = {s for n in front for s in back.get(n, ())} - seen
            seen |= front
            found.update({(change, n): hops for n in front})
    return found


@pytest.mark.parametrize("rows, columns", [(1, 1), (3, 4)])
def test_pairs_are_the_same_in_any_grid(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(graph, "_grid", lambda *size: (rows, columns))
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)]
    seeds = [(rnd.randrange(600), rnd.randrange(60)) for _ in range(700)]
    got = graph.blast_radius(spark.createDataFrame(edges, "src BIGINT, dst BIGINT"), spark.createDataFrame(seeds, "change BIGINT, node BIGINT"))
    assert {(r["change"], r["node"]): r["hops"] for r in got.collect()} == walk(edges, seeds)


def test_rounds_end_when_every_change_has_reached_every_receiver(spark, monkeypatch):
    turns, count = [], Workspace.counted
    monkeypatch.setattr(Workspace, "counted", lambda self, df, name, **w: (turns.append(name), count(self, df, name, **w))[1])
    edges = spark.createDataFrame([(s, d) for s in range(6) for d in range(6)], "src BIGINT, dst BIGINT")
    seeds = spark.createDataFrame([(c, c) for c in range(6)], "change BIGINT, node BIGINT")
    assert graph.blast_radius(edges, seeds).count() == 30
    assert turns.count("reached") == 2  # the seeds and one hop; a second hop would find nothing


def test_a_grid_moves_less_than_the_edges_and_grows_with_them():
    def moved(k):
        edges, senders, receivers = 600_000 * k, 7_000 * k, 20_000 * k
        rows, columns = graph._grid(edges, senders, receivers, 5)
        assert receivers * 5 / columns <= graph.GRID_ROWS and columns > 1
        return senders * columns + receivers * rows
    assert moved(6) < 600_000 * 6 / 4 and moved(360) <= 60 * moved(6)
    assert graph._grid(10**7, 10**7, 10**7, 1) == (1, 1)  # a chain
