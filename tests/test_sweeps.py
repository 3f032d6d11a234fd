"""Overlap partners and groups, and chunks cut where the rows are, against plain Python."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ashlar.operators.graph import replay_running
from ashlar.operators.ledger import definition_as_of
from ashlar.operators.quality import recovery_times, staleness_audit
from ashlar.operators.routing import overlap_groups, overlap_partners
from ashlar.operators.signal import capture_regions
from ashlar.plans import scans

DAY = dt.datetime(2024, 1, 1)
SESSIONS = "agent BIGINT, worktree BIGINT, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ"


def stamp(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def busy(seed, n):
    """A third of the sessions in one worktree, all on one day; repeated, touching and nested ones; one agent alone in a tree."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        tree = 1 if rnd.random() < 0.35 else rnd.randrange(2, 9)
        start = rnd.randrange(0, 400 if tree > 1 else 1300, 5)
        out.append((rnd.randrange(4), tree, stamp(start), stamp(start + rnd.choice([0, 5, 5, 10, 20, 60]))))
    out += [(7, 50, stamp(0), stamp(100)), (7, 50, stamp(50), stamp(150))]  # one agent, no overlap
    out += [(1, 60, stamp(0), stamp(100)), (2, 60, stamp(10), stamp(20)), (1, 60, stamp(30), stamp(200)), (3, 60, stamp(50), stamp(60))]
    out += [(1, 61, stamp(0), stamp(30)), (2, 61, stamp(10), stamp(20)), (1, 61, stamp(25), stamp(90)), (2, 61, stamp(60), stamp(70))]
    out += [(1, 62, stamp(0), stamp(10)), (1, 62, stamp(10), stamp(20)), (2, 62, stamp(0), stamp(20)), (3, 62, stamp(20), stamp(30))]
    return out + out[:20]


def pairs(sessions):
    merged = Counter(s for s in sessions if s[2] < s[3])
    return merged, [(a, b) for a in merged for b in merged if a[1] == b[1] and a[0] != b[0] and a[2] < b[3] and b[2] < a[3]]


def place(s):
    return s[2], s[3], s[0]


def expected_partners(sessions):
    merged, links = pairs(sessions)
    met = {}
    for a, b in links:
        met.setdefault(a, []).append(b)
    out = {}
    for a, others in met.items():
        before = [b for b in others if place(b) < place(a)]
        b = max(before, key=lambda s: (s[3], s[0], s[2])) if before else min(others, key=place)
        out[a] = (merged[a], b[0], b[2], b[3])
    return out


def expected_groups(sessions):
    merged, links = pairs(sessions)
    up = {s: s for pair in links for s in pair}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s
    for a, b in links:
        up[root(a)] = root(b)
    groups = {}
    for s in up:
        groups.setdefault(root(s), []).append(s)
    out = []
    for members in groups.values():
        own = [(a, b) for a, b in links if root(a) == root(members[0])]
        out.append((members[0][1], min(max(a[2], b[2]) for a, b in own), min(s[2] for s in members), max(s[3] for s in members),
                    sum(merged[s] for s in members), len({s[0] for s in members}), sum(merged[a] * merged[b] for a, b in own) // 2))
    return Counter(out)


@pytest.mark.parametrize("seed, rows", [(1, 1_000_000), (2, 40)])
def test_partners_and_groups_equal_all_pairs(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(scans, "CHUNK_ROWS", rows)
    sessions = busy(seed, 400)
    df = spark.createDataFrame(sessions, SESSIONS)
    got = {(r["agent"], r["worktree"], r["start"], r["end"]): (r["n"], r["partner_agent"], r["partner_start"], r["partner_end"])
           for r in overlap_partners(df).collect()}
    assert got == expected_partners(sessions)
    names = ["worktree", "since", "first_start", "last_end", "sessions", "agents", "links"]
    want = expected_groups(sessions)
    assert Counter(tuple(r[n] for n in names) for r in overlap_groups(df).collect()) == want
    assert [len([g for g in want if g[0] == tree]) for tree in (50, 60, 61, 62)] == [0, 1, 2, 1]


def test_no_sessions(spark):
    none = spark.createDataFrame([], SESSIONS)
    assert overlap_partners(none).isEmpty() and overlap_groups(none).isEmpty()


# -- chunks --------------------------------------------------------------------------------------


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(scans, "CHUNK_ROWS", 500)


def bulk(spark, n=20000):
    """All rows of one key on one day but for a few: a bulk load."""
    row = F.col("id")
    return spark.range(n).select(
        F.when(row % 50 == 0, row % 7).otherwise(99).alias("entity"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.when(row % 100 == 0, row % 30).otherwise(0).cast("int"))).alias("ts"),
        row.alias("seq"), ((row * 7919) % 101).alias("amount"))


def test_large_chunks_are_cut_where_the_rows_are(spark, small_chunks):
    rows = bulk(spark)
    chunk = F.date_trunc("month", F.col("ts").cast("timestamp"))
    sizes = [r["count"] for r in scans.split(rows, ["entity"], ["ts", "seq"], chunk).groupBy("entity", chunk, "_split").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) <= 3 * 500 and len(sizes) > 30
    ranges = scans.split(rows, ["entity"], ["ts", "seq"], chunk).filter("entity = 99").groupBy("_split").agg(
        F.min(F.struct("ts", "seq")).alias("low"), F.max(F.struct("ts", "seq")).alias("high")).orderBy("_split").collect()
    assert all(a["high"] < b["low"] for a, b in zip(ranges, ranges[1:], strict=False))


def test_small_chunks_stay_as_they_are(spark):
    assert scans.split(bulk(spark, 200), ["entity"], ["ts", "seq"], F.lit(0)).select("_split").distinct().collect() == [(0,)]


def test_running_values_over_a_bulk_load(spark, small_chunks):
    rows = bulk(spark)
    got = {r["seq"]: (r["balance"], r["events"]) for r in replay_running(rows, "month").collect()}
    sums, want = Counter(), {}
    for r in sorted(rows.collect(), key=lambda r: (r["entity"], r["ts"], r["seq"])):
        sums[r["entity"]] += r["amount"]
        sums[r["entity"], "n"] += 1
        want[r["seq"]] = (sums[r["entity"]], sums[r["entity"], "n"])
    assert got == want


def test_operators_agree_with_and_without_cut_chunks(spark, monkeypatch):
    rows = bulk(spark, 3000).cache()
    col = F.col
    decisions = rows.filter("seq % 3 = 0").select(col("entity").alias("term"), col("ts").alias("decided"), "seq")
    ledger = rows.filter("seq % 3 > 0").select(
        col("entity").alias("term"), col("ts").alias("recorded"), "seq", col("amount").alias("definition"), F.lit("s").alias("source"))
    marks = rows.select(col("entity").alias("store"), "ts", "seq", (col("amount") % 3 == 0).alias("good"), (col("amount") % 3 == 1).alias("failed"))
    reads, writes = rows.filter("amount > 50").select(col("entity").alias("key"), "ts", col("seq").alias("id")), rows.select(col("entity").alias("key"), "ts")
    samples = rows.select(col("entity").alias("track"), "ts", "seq", col("amount").alias("x"))
    control = rows.filter("amount % 9 = 0").select(
        col("entity").alias("track"), "ts", "seq", F.when(col("amount") % 2 == 0, "CAPTURE").otherwise("STOP").alias("event"))

    def results():
        frames = [definition_as_of(decisions, ledger), recovery_times(marks, 60.0, 60.0), capture_regions(samples, control),
                  staleness_audit(reads, writes.limit(0), writes, 60.0)]
        return [Counter(f.collect()) for f in frames]
    plain = results()
    monkeypatch.setattr(scans, "CHUNK_ROWS", 200)
    assert results() == plain and all(plain)
