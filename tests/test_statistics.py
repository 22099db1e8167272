import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.operators import evidence, skew, statistics
from tidemark.plans import views


def test_latency_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "ms double")
    r = statistics.latency_summary(df, "ms").first().asDict()
    assert (r["count"], r["mean"], r["median"], r["mad"]) == (10, 5.5, 5.5, 2.5)
    assert r["p90"] == pytest.approx(9.1) and r["p99"] == pytest.approx(9.91)


def plain_ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


def plain_psi(a, b):
    pooled = sorted([*a, *b])
    n = len(pooled)
    if n < 20:
        return None
    edges = sorted({pooled[int(i / 10 * (n - 1))] for i in range(1, 10)})
    shares = lambda x: [max(sum(sum(e < v for e in edges) == k for v in x) / len(x), 1e-6) for k in range(len(edges) + 1)]
    return sum((q - p) * math.log(q / p) for p, q in zip(shares(a), shares(b)))


@pytest.mark.parametrize("a, b", [([1.0, 2.0, 2.0, 3.0] * 8, [2.0, 3.0, 9.0] * 9), ([1.0] * 30, [1.0] * 30), ([1.0], [2.0]), ([float(i) for i in range(50)], [float(i) + 0.5 for i in range(50)])])
def test_drift(spark, a, b):
    left, right = (spark.createDataFrame([("f", x) for x in s], "k string, v double") for s in (a, b))
    assert statistics.ks_statistic(left, right, "v", ["k"]).first()["ks"] == pytest.approx(plain_ks(a, b))
    got, want = statistics.population_stability_index(left, right, "v", ["k"]).first()["psi"], plain_psi(a, b)
    assert got == want if want is None else got == pytest.approx(want)


def test_nearest_rank(spark):
    xs = [5, 1, 1, 9, 7, 3]
    r = statistics.nearest_rank(spark.createDataFrame([(x,) for x in xs], "v int"), "v").first()
    s = sorted(xs)
    assert (r["p50"], r["p99"], r["max"]) == (s[3], s[min(5, int(0.99 * 6))], 9)


TABLE = [
    ((None, None, 1.0), "match"),
    ((None, 1.0, 1.0), "one_side_null"),
    ((1.0, None, 1.0), "one_side_null"),
    ((1.0, 1.0, 2.0), "match"),
    ((1.0, 1.0 + 1e-8, 2.0), "match"),
    ((1.0, 2.0, 2.0), "partial_head_tile"),
    ((1.0, 2.0, 3.0), "late_arriving_data"),
    ((1.0, 2.0, None), "late_arriving_data"),
]


def test_classify(spark):
    df = spark.createDataFrame([(*x, want) for x, want in TABLE], "s double, t double, k double, want string")
    got = df.select(skew.classify(df.s, df.t, df.k).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_log_entry(spark):
    view = views.USER_DAY
    values = {n: 1.0 for n in view.feature_names} | {"count_1h": None}
    entry = skew.build_log_entry(view, "a", {"user_id": 5, "other": 1}, values, 10, 11)
    assert entry["entity_keys"] == {"user_id": "5"}
    for bad in (lambda: skew.build_log_entry(view, "a", {}, values, 10, 11), lambda: skew.build_log_entry(view, "a", {"user_id": 5}, {}, 10, 11), lambda: skew.build_log_entry(view, "a", {"user_id": 5}, values, 10, 9)):
        with pytest.raises(ValueError):
            bad()
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(entry)]), schema=skew.LOG_DDL)
    rows = skew.explode_log(df).collect()
    assert len(rows) == len(view.feature_names) and [r.value for r in rows if r.feature_name == "count_1h"] == [None]


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=30))
def test_artifact_round_trip(samples):
    a = evidence.build_artifact("online_latency", {}, samples, "2026-01-01T00:00:00Z", {})
    assert evidence.validation_errors(a) == []
    assert evidence.validation_errors(a | {"raw_samples_ms": [*samples, 1.0]})
    assert evidence.validation_errors(a | {"statistics": a["statistics"] | {"p90": -1.0}})


def test_artifact_file(tmp_path):
    a = evidence.build_artifact("streaming_lag", {}, [1.0, 2.0], "now", {})
    evidence.write_artifact(a, tmp_path / "a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == a
    with pytest.raises(ValueError):
        evidence.write_artifact(a | {"config": {"x": math.nan}}, tmp_path / "a.json")
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"]


def test_auc_by_pairs(spark):
    rows = [(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1), (0.5, 0), (3.0, 0), (None, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    held = [r for r in rows if r[0] is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert statistics.auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    assert statistics.auc(df.filter("y = 0"), "s", "y").first()["auc"] is None


def test_running_sums_of_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 2.0, 3), (None, 1.0, 1), ("a", 5.0, 2)], "k string, v double, n int")
    got = {(r.k, r.v): (r.n_upto, r.n_all) for r in statistics.running(df, ["k"], "v", ["n"]).collect()}
    assert got == {(None, 1.0): (1, 4), (None, 2.0): (4, 4), ("a", 5.0): (2, 2)}
    none = df.limit(0)
    assert statistics.ks_statistic(none, none, "v", ["k"]).count() == 0
    assert statistics.latency_summary(none, "v").first()["median"] is None
