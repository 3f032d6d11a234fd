"""Votes and their posterior: held against the labels, which are never an input, and against a plain fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [r.asDict() for r in quality.judge(docs.withColumn("p_good", F.lit("x")).withColumn("kept", F.lit(1))).collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_the_posterior_decides_where_the_base_rule_does_not(judged, labels):
    open_ = [r for r in judged if not r["base_failed"] and labels.get(r["doc_id"]) is not None]
    bad = [r for r in open_ if labels[r["doc_id"]] == 0]
    good = [r for r in open_ if labels[r["doc_id"]] == 1]
    assert len(bad) > 20 and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(not r["kept"] for r in good) <= 0.01 * len(good)
    assert sum(not r["kept"] and not r["base_failed"] for r in judged) > 50


def test_kept_follows_the_fit_on_real_rows(judged):
    patterns, counts = np.unique([r["pattern"] for r in judged], return_counts=True)
    votes = np.stack([patterns // 3**i % 3 - 1 for i in range(len(quality.rules()))], axis=1)
    p, accuracy, share = quality.fit_votes(votes, counts.astype(float))
    by_pattern = dict(zip(patterns.tolist(), p.tolist(), strict=True))
    for r in judged:
        assert abs(r["p_good"] - by_pattern[r["pattern"]]) < 1e-12
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    assert 0.5 < share < 1 and (accuracy.sum(axis=0) >= 1 - 1e-9).all()


def test_the_fit_finds_planted_bad_documents():
    """Two rules see each kind of bad document: misses don't speak for a document, a hit speaks against it."""
    rng = np.random.default_rng(8)
    n, kinds = 20000, 5
    bad = rng.random(n) < 0.15
    kind = rng.integers(0, kinds, n)
    votes = np.ones((n, 2 * kinds), int)
    for k in range(2 * kinds):
        votes[:, k] = np.where(np.where(bad & (kind == k % kinds), rng.random(n) < 0.9, rng.random(n) < 0.01), 0, 1)
        votes[rng.random(n) < 0.1, k] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, _, _ = quality.fit_votes(patterns, counts.astype(float))
    caught = p[inverse.ravel()] < 0.5
    assert caught[bad].mean() > 0.9 and caught[~bad].mean() < 0.1 and not caught[(votes != 0).all(1)].any()
