"""Keys of few rows are swept whole in tasks dealt by rows, others by chunks, with the same results."""

from collections import Counter

import pytest
from test_sweeps import SESSIONS, busy, expected_groups, expected_partners, pairs

from ashlar.operators import routing
from ashlar.plans import scans


def expected_peaks(sessions):
    marks = sorted((at, side, s[1]) for s in sessions if s[2] < s[3] for side, at in ((1, s[2]), (0, s[3])))
    now, peak = Counter(), Counter()
    for _, side, tree in marks:
        now[tree] += 1 if side else -1
        peak[tree] = max(peak[tree], now[tree])
    return dict(peak)


@pytest.mark.parametrize("whole, chunk", [(1_000_000, 1_000_000), (30, 1_000_000), (0, 1_000_000), (30, 40)])
def test_sweeps_agree_however_keys_are_dealt(spark, monkeypatch, whole, chunk):
    monkeypatch.setattr(scans, "WHOLE_ROWS", whole)
    monkeypatch.setattr(scans, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(scans, "TASK_ROWS", 100)
    sessions = [*busy(3, 300), *busy(4, 20)]
    df = spark.createDataFrame(sessions, SESSIONS)
    partners = {(r["agent"], r["worktree"], r["start"], r["end"]): (r["n"], r["partner_agent"], r["partner_start"], r["partner_end"])
                for r in routing.overlap_partners(df).collect()}
    assert partners == expected_partners(sessions)
    assert Counter(tuple(r) for r in routing.overlap_groups(df).collect()) == expected_groups(sessions)
    merged, links = pairs(sessions)
    counts = Counter()
    for a, b in links:
        counts[a] += merged[b]
    got = {(r["agent"], r["worktree"], r["start"], r["end"]): r["overlaps"] for r in routing.worktree_overlaps(df).collect()}
    assert got == counts
    assert {r["worktree"]: r["peak"] for r in routing.peak_concurrency(df).collect()} == expected_peaks(sessions)


@pytest.mark.parametrize("operator", ["worktree_overlaps", "overlap_partners", "overlap_groups", "peak_concurrency"])
def test_small_worktrees_are_shuffled_once_into_tasks_by_rows(spark, monkeypatch, operator):
    monkeypatch.setattr(scans, "TASK_ROWS", 20)
    df = getattr(routing, operator)(spark.createDataFrame(busy(5, 400), SESSIONS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert df.rdd.getNumPartitions() > 15


def test_null_worktrees_stay_together(spark, monkeypatch):
    rows = [(agent, None, start, end) for agent, _, start, end in busy(6, 60)]
    df = spark.createDataFrame(rows, SESSIONS)
    peaks = []
    for whole in (1_000_000, 0):
        monkeypatch.setattr(scans, "WHOLE_ROWS", whole)
        peaks.append([tuple(r) for r in routing.peak_concurrency(df).collect()])
    assert peaks[0] == peaks[1] == [(None, peaks[0][0][1])]
