"""The law of the splitting tree: hypergeometric draws by exact inversion, exact sums at every node."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def inverse(u, whole, own, draws):
    """The same inversion over the whole support, in plain Python."""
    low, high = max(0, draws - (whole - own)), min(own, draws)
    comb = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    logs = [comb(own, k) + comb(whole - own, draws - k) for k in range(low, high + 1)]
    most = max(logs)
    mass = [math.exp(x - most) for x in logs]
    goal, run = u * sum(mass), 0.0
    for k, m in enumerate(mass, low):
        run += m
        if run >= goal:
            return k
    return high


CASES = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (4, 1, 2), (16, 8, 8), (400, 200, 200), (401, 3, 200), (8000, 4000, 4000), (50_000, 49_000, 25_000), (1_000_000, 400_000, 500_000), (2_000_000, 1_000_000, 1_000_000)]


@pytest.fixture(scope="module")
def drawn(spark):
    """Draws at 400 evenly spread values of u for each case."""
    rows = [(c, (i + 0.5) / 400, *CASES[c]) for c in range(len(CASES)) for i in range(400)]
    df = spark.createDataFrame(rows, "c int, u double, whole bigint, own bigint, draws bigint")
    out = defaultdict(list)
    for r in df.withColumn("k", mixing.hypergeometric(*map(F.col, ("u", "whole", "own", "draws")))).collect():
        out[r.c].append((r.u, r.k))
    return out


def test_draws_are_inversions(drawn):
    for c, case in enumerate(CASES):
        some = drawn[c][::10] if case[0] <= 10_000 else drawn[c][::150]
        wrong = [(u, k) for u, k in some if k != inverse(u, *case)]
        # a value whose goal falls on the edge of two may go either way by a rounding
        assert len(wrong) <= 1 and all(abs(k - inverse(u, *case)) <= 1 for u, k in wrong), (case, wrong)


def test_mean_and_variance(drawn):
    for c, (whole, own, draws) in enumerate(CASES):
        ks = [k for _, k in drawn[c]]
        mean = draws * own / whole
        law = mean * (1 - own / whole) * (whole - draws) / max(whole - 1, 1)
        got = sum(ks) / len(ks)
        assert abs(got - mean) <= 0.01 * math.sqrt(law) + 0.02
        assert sum((k - got) ** 2 for k in ks) / len(ks) == pytest.approx(law, rel=0.03, abs=0.01)


@pytest.mark.parametrize("quotas, shards", [((1, 1, 1, 1), 2), ((1, 2, 3, 50, 300), 8), ((7, 1_000_000, 20_000), 4), (tuple(range(1, 41)), 4)])
def test_every_node_is_exact(spark, quotas, shards):
    named = [(f"s{i}" if i else None, q) for i, q in enumerate(quotas)]
    df = spark.createDataFrame(named, "source string, units bigint")
    for seed in (1, 2):
        got = mixing.split_quotas(df, shards, seed).collect()
        sums = [sum(r.units for r in got if r.shard == k) for k in range(shards)]

        def halves(total, parts):
            return [total] if parts == 1 else halves(total // 2, parts // 2) + halves(total - total // 2, parts // 2)

        assert sums == halves(sum(quotas), shards)
        for source, q in named:
            at = 0
            for r in sorted((r for r in got if r.source == source), key=lambda r: r.shard):
                assert r.first == at and r.units > 0
                at += r.units
            assert at == q


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    """A third of all rows share an id: their block is cut up, and sums stay exact."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    rows = [(None if i % 3 == 0 else i, "a b c d e " * (1 + i % 4), "xyz"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_documents(df).collect()
    total = sum(r.size for r in got)
    assert len(got) == 600 and abs(sum(r.taken for r in got) - 1.5 * total) <= 2
    assert all(r.taken <= 2 * r.size for r in got)
    shards = {d.shard for r in got if r.doc_id is None for d in r.draws}
    assert len(shards) > 4
