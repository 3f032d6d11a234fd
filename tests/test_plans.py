"""Shared plan shapes against brute force, and what the physical plans must not contain."""

import random
import re
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ashlar.operators.graph import blast_radius, cycle_members, failure_domains
from ashlar.operators.records import resolve_supersession
from ashlar.plans.asof import asof_join
from ashlar.plans.loops import Workspace, shared_dir
from ashlar.plans.numbering import number_rows
from ashlar.plans.quantiles import exact_percentiles
from ashlar.plans.scans import last, running_max, running_sum, scan

SF_DIR = "/root/testdata/sf0.001"


def hot_rows(spark):
    """One key holds a third of the rows; some keys and values are null; times have ties."""
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rnd.choice([None, "a", "b", "c"])
        rows.append((key, rnd.randrange(200), i, rnd.choice([None, rnd.randrange(50)])))
    return spark.createDataFrame(rows, "k STRING, t INT, seq INT, v INT")


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_equals_a_plain_window(spark, reverse):
    df = hot_rows(spark)
    carries = {
        "l": last(F.col("v")),
        "lx": last(F.col("v"), inclusive=False),
        "s": running_sum(F.col("v")),
        "m": running_max(F.col("v"), inclusive=False),
    }
    got = scan(df, ["k"], ["t", "seq"], F.floor(F.col("t") / 7), carries, reverse=reverse)
    order = [F.col(c).desc() if reverse else F.col(c) for c in ["t", "seq"]]
    w = Window.partitionBy("k").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*",
        F.last("v", ignorenulls=True).over(upto).alias("l"),
        F.last("v", ignorenulls=True).over(before).alias("lx"),
        F.sum("v").over(upto).alias("s"),
        F.max("v").over(before).alias("m"),
    )
    assert got.count() == 900
    assert got.select(want.columns).exceptAll(want).isEmpty()


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, strict):
    rnd = random.Random(3)
    left = [(rnd.choice("ab"), f"2024-0{rnd.randrange(1, 7)}-{rnd.randrange(10, 28)} 00:00:00", i) for i in range(200)]
    right = [(rnd.choice("ab"), f"2024-0{rnd.randrange(1, 7)}-{rnd.randrange(10, 28)} 00:00:00", i) for i in range(40)]
    l = spark.createDataFrame(left, "k STRING, t STRING, id INT").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = spark.createDataFrame(right, "k STRING, rt STRING, seq INT").withColumn("rt", F.col("rt").cast("timestamp_ntz"))
    got = asof_join(l, r, ["k"], "t", "rt", ["seq"], tie=["seq"], strict=strict)
    by_key = {k: sorted((t, s) for kk, t, s in right if kk == k) for k in "ab"}
    for row in got.collect():
        t = str(row["t"])
        hits = [s for rt, s in by_key[row["k"]] if (rt < t if strict else rt <= t)]
        assert row["seq"] == (hits[-1] if hits else None)


@pytest.mark.parametrize("shape", ["normal", "few values", "one value"])
def test_exact_percentiles(spark, shape):
    rng = np.random.default_rng(5)
    n = 3000
    values = {"normal": rng.normal(size=n), "few values": rng.integers(0, 3, n).astype(float), "one value": np.ones(n)}[shape]
    groups = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b"], n))
    df = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())) + [("empty", None), (None, 4.0)], "g STRING, v DOUBLE")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"hot", "a", "b", None} and got[None]["p50"] == 4.0
    for g in ["hot", "a", "b"]:
        mine = values[groups == g]
        assert got[g]["n"] == len(mine)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(mine, p))


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([("a", 0.0, 7), ("a", 5.0, 1), ("a", 9.0, 2), ("a", 3.0, 0)], "g STRING, v DOUBLE, w BIGINT")
    row = exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, weight=F.col("w")).first()
    plain = [0.0] * 7 + [5.0] + [9.0] * 2
    assert row["n"] == 10 and row["p50"] == np.quantile(plain, 0.5) and row["p95"] == pytest.approx(np.quantile(plain, 0.95))


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1000)], "d INT").distinct()
    rows = number_rows(df, ["d"], "n").orderBy("d").collect()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))


def random_edges(seed, nodes, count):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(count)})


def reach_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), list(out.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(out.get(n, ()))
        reach[start] = seen
    return reach


@pytest.mark.parametrize("seed, nodes, count", [(1, 40, 45), (3, 60, 62), (4, 25, 80)])
def test_cycle_members_and_domains(spark, seed, nodes, count):
    edges = random_edges(seed, nodes, count)
    df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
    reach = reach_of(edges)
    want = {n: min(m for m in r if n in reach.get(m, ())) for n, r in reach.items() if n in r}
    got = {r["node"]: r["grp"] for r in cycle_members(df).collect()}
    assert got == want
    both = reach_of(edges + [(b, a) for a, b in edges])
    domains = {r["node"]: r["domain"] for r in failure_domains(df).collect()}
    assert domains == {n: min(r | {n}) for n, r in both.items()}
    assert all(domains[n] == domains[g] for n, g in got.items())


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    df = spark.createDataFrame(chain, "src BIGINT, dst BIGINT")
    domains = {r["node"]: r["domain"] for r in failure_domains(df).collect()}
    assert {domains[i] for i in range(301)} == {0} and {domains[i] for i in range(1000, 1400)} == {1000} and domains[5000] == 5000


def test_cycles_without_edges(spark):
    empty = spark.createDataFrame([], "src BIGINT, dst BIGINT")
    assert cycle_members(empty).isEmpty() and failure_domains(empty).isEmpty()


def test_blast_radius(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6)]
    df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
    seeds = spark.createDataFrame([(1, 3), (1, 6), (2, 3), (2, 2)], "change BIGINT, node BIGINT")
    got = sorted(tuple(r) for r in blast_radius(df, seeds).select("change", "node", "hops").collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 4, 1), (1, 5, 2), (2, 1, 1), (2, 4, 1), (2, 5, 2)]
    assert blast_radius(df, seeds, 1).count() == 4


def test_blast_radius_follows_a_long_chain_to_its_end(spark):
    chain = spark.range(40).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    got = blast_radius(chain, spark.createDataFrame([("c", 0)], "change STRING, node BIGINT"))
    assert sorted((r["node"], r["hops"]) for r in got.collect()) == [(n, n) for n in range(1, 41)]


def test_supersession(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 4), (7, 99), (8, 8), (9, 1)] + [(100 + i, 101 + i) for i in range(60)] + [(160, None)]
    got = {r["num"]: (r["final"], r["hops"], r["state"]) for r in resolve_supersession(spark.createDataFrame(rows, "num BIGINT, superseded_by BIGINT")).collect()}
    assert got[1] == (3, 2, "resolved") and got[3] == (3, 0, "resolved") and got[9] == (3, 3, "resolved")
    assert got[100] == (160, 60, "resolved")
    assert got[7] == (99, 1, "dangling")
    assert all(got[n] == (None, None, "loop") for n in (4, 5, 6, 8))


def test_workspace_slots(spark):
    space = Workspace(spark)
    df, n = space.state(spark.range(5), "x")
    assert n == 5
    for i in range(4):
        df, n = space.state(df.withColumn("id", F.col("id") + 1), "x", F.col("id") > 6)
    assert sorted(r["id"] for r in df.collect()) == [4, 5, 6, 7, 8] and n == 2


def test_shared_dir_is_the_one_the_session_names(spark, shared):
    assert shared_dir(spark) == str(shared)
    before = len(list(shared.iterdir()))
    Workspace(spark).keep(spark.range(3))
    assert len(list(shared.iterdir())) == before + 1


def whole_graph(spark):
    """Touched nodes of each release date, and who depends on whom, from all years of the smallest lineitem."""
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_shipdate", "l_partkey", F.expr("l_suppkey * 20 + l_linenumber")).collect()
    back, touched = {}, {}
    for date, src, dst in rows:
        back.setdefault(dst, set()).add(src)
        touched.setdefault(date, set()).add(dst)
    return back, touched


def hops_from(back, nodes):
    hops, ring, hop = dict.fromkeys(nodes, 0), set(nodes), 0
    while ring:
        hop += 1
        ring = {up for n in ring for up in back.get(n, ())} - set(hops)
        hops.update(dict.fromkeys(ring, hop))
    return hops


def test_cycles_of_the_whole_graph_cross_years(spark):
    back, _ = whole_graph(spark)
    reach = {n: set().union(*(hops_from(back, [up]) for up in ups)) for n, ups in back.items()}
    want = {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in reach if n in reach[n]}
    got = {r["node"]: r["grp"] for r in entry.queries()["d4_cycle_members_whole"](spark, SF_DIR).collect()}
    assert want and got == want


def test_each_release_date_is_a_change_on_the_whole_graph(spark):
    back, touched = whole_graph(spark)
    got = entry.queries()["d7_blast_radius_whole"](spark, SF_DIR).select("change", "node", "hops").toArrow().to_pydict()
    want = {(d, n): h for d, nodes in touched.items() for n, h in hops_from(back, nodes).items() if h}
    assert len(touched) > 100 and len(got["node"]) == len(want)
    days = [str(d)[:10] for d in got["change"]]
    assert dict(zip(zip(days, got["node"]), got["hops"])) == {(str(d)[:10], n): h for (d, n), h in want.items()}


LOOPS = {"d4_cycle_members", "d7_blast_radius", "d8_failure_domains", "b2_resolve_supersession"}
STREAMS = {n for n in entry.queries() if n.endswith(("_stream", "_watch"))} | {"i1_read_records", "i2_write_artifacts"}


#: Training-data operators may run Python in their tasks; their own tests watch them.
IN_TASKS = {n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - LOOPS - STREAMS - IN_TASKS))
def test_no_products_and_no_python_in_batch_plans(name, spark):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]:
        assert bad not in plan, plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["c7_path_latency"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = entry.queries()["e3_finding_lint"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["c11_hot_spots"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_percentiles_read_their_input_once(spark):
    df = entry.queries()["c7_path_latency"](spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_every_operator_of_the_inventory_has_a_query():
    sizes = {"a": 7, "b": 12, "c": 28, "d": 18, "e": 8, "f": 9, "g": 6, "h": 11, "i": 4}
    ids = {n.split("_")[0] for n in set(entry.queries()) - IN_TASKS}
    assert ids == {f"{family}{i}" for family, n in sizes.items() for i in range(1, n + 1)}
