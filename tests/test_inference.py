import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resampla import api
from resampla.functions import tails, text
from resampla.operators import confounding, linear, logistic, report, resample
from resampla.plans import frame as frame_module
from resampla.plans import exchange, kernel
from resampla.plans.frame import CollinearFeatureError, moments, outcome_kind, prepare


def frame_of(spark, cols, target="y"):
    names = list(cols)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(*cols.values()), 10)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(1)
    a, z = r.normal(size=40), r.normal(size=40)
    b = 0.5 * a + r.normal(size=40)
    y = a + 0.3 * b - z + r.normal(size=40)
    return frame_of(spark, {"a": a, "b": b, "z": z, "y": y}), np.c_[a, b, z], y


def ols(x, y):
    return np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)[0]


def test_tails_match_closed_forms():
    for t in (0.1, 1.0, 3.7):
        assert tails.t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
        assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)
        assert tails.chi2_upper(t, 2) == pytest.approx(math.exp(-t / 2), rel=1e-12)
        assert tails.f_upper(t * t, 1, 17) == pytest.approx(tails.t_two_sided(t, 17), rel=1e-12)
        assert tails.t_two_sided(t, 1e7) == pytest.approx(tails.z_two_sided(t), rel=1e-5)
    assert math.isnan(tails.pearson_p(math.nan, 9)) and tails.pearson_p(1.0, 9) == 0 and tails.pearson_p(0.4, 2) == 1


@settings(max_examples=50, deadline=None)
@given(st.floats(0.01, 60), st.integers(1, 400))
def test_tails_are_probabilities_and_fall(x, df):
    assert 1 >= tails.t_two_sided(x, df) >= tails.t_two_sided(x * 1.1, df) >= 0
    assert 1 >= tails.chi2_upper(x, df) >= tails.chi2_upper(x * 1.1, df) >= 0


def test_marks():
    assert [text.star(p, 0.05, 0.01) for p in (0.05, 0.01, 0.0099, math.nan)] == [" (ns)", " (*)", " (**)", " (ns)"]
    assert text.marked(0.0005, 4, 0.05, 0.01) == "0.0005 (**)"
    assert [text.short("x" * n, 25) for n in (25, 26)] == ["x" * 25, "x" * 22 + "..."]


def replay(spark, x, columns, name, seed, count):
    """Permuted values in the order of positions, per replicate."""
    frame = spark.createDataFrame([(i + 1, *map(float, np.atleast_1d(r))) for i, r in enumerate(x)], "rid long, " + ", ".join(f"{c} double" for c in columns))
    rows = resample.permuted(frame, len(x), count, seed, name, columns).orderBy("rep", "pos").collect()
    return [[np.array([r[c] for c in columns]) for r in g] for _, g in itertools.groupby(rows, key=lambda r: r["rep"])]


def test_linear_formulas_equal_refits(spark, sample):
    df, x, y = sample
    features, count, seed = ["a", "b", "z"], 7, 3
    frame = prepare(df, "id", features, "y")
    m = moments(frame, [*features, "y"])
    braak = {(r["rep"], r["feature"]): r["stat"] for r in linear.ter_braak(frame, m, features, "y", count, seed).collect()}
    ken = {(r["rep"], r["feature"]): r["stat"] for r in linear.kennedy(frame, m, features, "y", ["z"], count, seed).collect()}
    one = np.ones(len(y))
    for j, c in enumerate(features):
        rest = np.delete(x, j, 1)
        e = y - np.c_[one, rest] @ ols(rest, y)
        for rep, moved in enumerate(replay(spark, e, ["e"], c, seed, count), 1):
            refit = ols(x, y - e + np.array(moved)[:, 0])[j + 1]
            assert braak[rep, c] == pytest.approx(refit, abs=1e-10)
        if c != "z":
            hat = np.c_[one, x[:, 2]] @ ols(x[:, 2:], x[:, j])
            for rep, moved in enumerate(replay(spark, x[:, j] - hat, ["r"], c, seed, count), 1):
                w = x.copy()
                w[:, j] = hat + np.array(moved)[:, 0]
                assert ken[rep, c] == pytest.approx(ols(w, y)[j + 1], abs=1e-10)
    observed, rows = linear.kennedy_joint(frame, m, features, "y", ["z"], count, seed)
    rss = lambda a: float(((y - np.c_[one, a] @ ols(a, y)) ** 2).sum())
    assert observed == pytest.approx(rss(x[:, 2:]) - rss(x))
    hat = np.c_[one, x[:, 2]] @ ols(x[:, 2:], x[:, :2])
    got = {r["rep"]: r["improvement"] for r in rows.collect()}
    for rep, moved in enumerate(replay(spark, x[:, :2] - hat, ["x0", "x1"], "joint", seed, count), 1):
        assert got[rep] == pytest.approx(rss(x[:, 2:]) - rss(np.c_[hat + np.array(moved), x[:, 2]]), abs=1e-9)


def test_results_do_not_depend_on_order_or_partitions(spark, sample):
    df, _, _ = sample
    runs = [api.permutation_test_regression(d, "id", ["a", "b", "z"], "y", 19, random_state=5, plan="rows") for d in (df, df.orderBy("y").repartition(7))]
    assert runs[0]["p_values"] == runs[1]["p_values"]
    assert all(1 / 20 <= p <= 1 for p in runs[0]["p_values"])
    again = [api.permutation_test_regression(df, "id", ["a", "b", "z"], "y", 19, random_state=5, plan="replicates")["p_values"] for _ in range(2)]
    assert again[0] == again[1] == runs[0]["p_values"]


def test_permutations_are_bijections_that_look_drawn(spark, sample, monkeypatch):
    for n in (1, 2, 3, 40, 1000):
        rid = np.arange(1, n + 1)
        sent = [resample.positions(rid, n, 7, "a", r) for r in range(1, 41)]
        assert all(sorted(p) == rid.tolist() for p in sent)
    moved = np.array([resample.positions(np.arange(1, 9), 8, 7, "b", r) for r in range(1, 4001)])
    share = np.array([[(moved[:, i] == j).mean() for j in range(1, 9)] for i in range(8)])
    assert abs(share - 1 / 8).max() < 0.025 and abs(np.mean(moved[:, 0] < moved[:, 1]) - 0.5) < 0.04
    u = resample.uniforms(np.arange(1, 50_001), 7, "b", 1)
    assert 0 <= u.min() < u.max() < 1 and abs(np.histogram(u, 10, (0, 1))[0] / 5000 - 1).max() < 0.08
    df, _, _ = sample
    frame = prepare(df, "id", ["a"], "y")
    shared = resample.permuted(frame, 40, 3, 1, "a", ["a"], "d").collect()
    monkeypatch.setattr(resample, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, shared)) == sorted(map(tuple, resample.permuted(frame, 40, 3, 1, "a", ["a"], "d").collect()))


def test_row_numbers_of_any_ids_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(3)
    ids = ["k%d" % x for x in r.integers(0, 40, 60)]
    df = spark.createDataFrame([(k, float(i), float(i % 7)) for i, k in enumerate(ids)], "id string, a double, y double")
    want = [a for _, a in sorted((k, float(i)) for i, k in enumerate(ids))]
    for rows in (10**6, 9):
        monkeypatch.setattr(frame_module, "ROWS_PER_RANK", rows)
        assert [x["a"] for x in prepare(df, "id", ["a"], "y").orderBy("rid").collect()] == want
    with pytest.raises(ValueError, match="infinite"):
        prepare(df.selectExpr("id", "case when a = 3 then double('inf') else a end as a", "y"), "id", ["a"], "y")


def test_refits_where_rows_lie_equal_joint_newton_steps(spark, monkeypatch):
    r = np.random.default_rng(12)
    a, b = r.normal(size=90), r.normal(size=90)
    df = frame_of(spark, {"a": a, "b": b, "y": (r.random(90) < 1 / (1 + np.exp(-a))).astype(float)})
    frame = prepare(df, "id", ["a", "b"], "y")
    m = moments(frame, ["a", "b", "y"])
    go = lambda: sorted((x["rep"], x["feature"], round(x["stat"], 6), x["sound"]) for x in logistic.ter_braak(frame, m, ["a", "b"], "y", 6, 3).collect())
    near = go()
    monkeypatch.setattr(logistic, "FEW_ROWS", 5)
    monkeypatch.setattr(exchange, "LEAST", 16)
    assert len(near) == 12 and go() == near


def test_found_confounders_title_and_logistic_block():
    assert text.FOUND_TITLE.format(p="x1", c=["x2"], k="Linear") == "Kennedy (1995) Method for 'x1' (controlling for ['x2']) (Linear)"
    result = {"model_type": "logistic", "method": "kennedy", "model_coefs": [1.0], "permuted_p_values": ["0.01 (*)"], "classic_p_values": ["0.2 (ns)"], "p_value_threshold_one": 0.05, "p_value_threshold_two": 0.01, "diagnostics": {"pseudo_r_squared": 0.25, "log_likelihood": -3.5, "log_likelihood_null": -4.5, "llr_p_value": 0.5}}
    said = report.coefficient_report(result, ["a"], "y")
    assert "Pseudo R-sq:" in said and "LL-Null:" in said and "5.0000e-01" in said and "P>|z| (Emp)" in said


def test_observed_model(spark, sample):
    df, x, y = sample
    features = ["a", "b", "z"]
    frame = prepare(df, "id", features, "y")
    m = moments(frame, [*features, "y"])
    assert [c["coef"] for c in linear.coefficients(m, features, "y")] == pytest.approx(list(ols(x, y)[1:]))
    d = linear.diagnostics(m, features, "y")
    assert d["f_p_value"] == pytest.approx(tails.f_upper(d["f_statistic"], 3, 36)) and 0 < d["r_squared_adj"] < d["r_squared"] < 1


def test_logistic_plans_and_kernel(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=80), r.normal(size=80)
    y = (r.random(80) < 1 / (1 + np.exp(-a))).astype(float)
    df = frame_of(spark, {"a": a, "b": b, "y": y})
    out = {p: api.permutation_test_regression(df, "id", ["a", "b"], "y", 9, method="kennedy", confounders=["b"], random_state=1, plan=p) for p in ("rows", "replicates")}
    beta, dev, sound = kernel.newton(np.c_[a, b], y)
    assert sound and out["rows"]["model_coefs"] == pytest.approx(list(beta[1:]), abs=1e-6)
    assert out["rows"]["diagnostics"]["log_likelihood"] == pytest.approx(-dev / 2, abs=1e-4)
    for o in out.values():
        assert o["p_values"] == out["rows"]["p_values"]
        assert o["model_type"] == "logistic" and o["permuted_p_values"][1] == text.MASKED and 0.1 <= o["p_values"][0] <= 1
    joint = api.permutation_test_regression(df, "id", ["a", "b"], "y", 9, method="kennedy_joint", random_state=1)
    assert joint["metric_type"] == "Deviance Reduction" and joint["observed_improvement"] > 0


@pytest.mark.parametrize("values,kind", [([0, 1], "logistic"), ([-1, 1], "linear"), ([1, 2], "linear"), ([0, 0], "linear"), ([1, 1], "linear"), ([0, 1, 2], "linear")])
def test_outcome_kind(spark, values, kind):
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    assert outcome_kind(df, "y") == kind


def test_bad_inputs(spark, sample):
    df, _, _ = sample
    go = lambda d, f, **k: api.permutation_test_regression(d, "id", f, "y", 5, random_state=1, **k)
    with pytest.raises(ValueError, match="Invalid method"):
        go(df, ["a"], method="other")
    with pytest.raises(ValueError, match="no features"):
        go(df, ["a"], method="kennedy", confounders=["q"])
    with pytest.raises(ValueError, match="nothing is left"):
        go(df, ["a"], method="kennedy_joint", confounders=["a"])
    with pytest.raises(ValueError, match="at least one"):
        api.permutation_test_regression(df, "id", ["a"], "y", 0)
    with pytest.raises(CollinearFeatureError):
        go(df.withColumn("c", df.a * 2), ["a", "c"])
    with pytest.raises(CollinearFeatureError):
        go(df.selectExpr("*", "1.0 as k"), ["a", "k"])
    hole = df.selectExpr("id", "case when id = 10 then null else a end as a", "y")
    with pytest.raises(ValueError, match="null"):
        go(hole, ["a"])
    assert go(hole, ["a"], na="drop")["diagnostics"]["n_observations"] == 39
    assert len(go(df, ["a"])["p_values"]) == 1
    every = go(df, ["a", "b"], method="kennedy", confounders=["a", "b"])
    assert every["permuted_p_values"] == [text.MASKED] * 2


def test_mediation_identities(spark, sample):
    df, _, _ = sample
    r = api.mediation_analysis(df, "id", ["a", "b", "z"], "y", "a", "b", 50, random_state=4)
    assert r["total_effect"] == pytest.approx(r["direct_effect"] + r["a_path"] * r["b_path"], abs=5e-4)
    lo, hi = r["indirect_effect_ci"]
    assert r["is_mediator"] == (lo > 0 or hi < 0) and lo <= hi
    found = api.identify_all(df, "id", ["a", "b", "z"], "y", n_bootstrap=50, random_state=4)
    for s in found:
        named = s["identified_confounders"] + s["identified_mediators"]
        assert sorted(named) == sorted(s["mediation_results"]) == sorted(t["feature"] for t in s["screening_results"] if t["is_candidate"])


def test_constant_column_is_never_a_candidate(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, float(i % 3)) for i in range(9)], "rid long, a double, k double, y double")
    row = confounding.screen(df, ["a", "k"], "y", ["a"]).first()
    assert row["r_pred"] is None and row["is_candidate"] is False


def test_report_layout():
    result = {"model_type": "linear", "method": "ter_braak", "model_coefs": [1.23456], "permuted_p_values": ["0.01 (*)"], "classic_p_values": ["0.2 (ns)"], "p_value_threshold_one": 0.05, "p_value_threshold_two": 0.01,
              "diagnostics": {"n_observations": 9, "n_features": 1, "aic": 1.5, "bic": 2.5, "r_squared": 0.5, "r_squared_adj": 0.4, "f_statistic": 3.0, "f_p_value": 0.0123456}}
    lines = report.coefficient_report(result, ["x" * 30], "t" * 30).split("\n")
    assert lines[0] == "=" * 80 and lines[1] == "Permutation Test Results".center(80)
    assert lines[3] == "Dep. Variable:  " + "t" * 17 + "...    " + "No. Observations:".rjust(27) + " " + "9".rjust(10)
    assert lines[8].endswith("1.2346e-02") and lines[-4] == "x" * 22 + "... " + "1.2346".rjust(12) + " " + "0.01 (*)".rjust(18) + " " + "0.2 (ns)".rjust(18)
    joint = report.joint_report(result | {"metric_type": "RSS Reduction", "features_tested": ["a", "b"], "confounders": [], "observed_improvement": 2.0, "p_value_str": "0.01 (*)"})
    assert "Features Tested: a, b" in joint and "Confounders" not in joint and "Joint p-Value:                     0.01 (*)" in joint


def test_totals_are_added_in_the_order_of_keys_for_any_partitions(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last bit, and so would distinct totals."""
    from resampla.sources import tables

    spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    price = {1: [0.1, 0.2, 0.3], 2: [0.1, 0.2, 0.3]}
    rows = [(10 * i + c, c, "F", p) for c, l in price.items() for i, p in enumerate(l)]
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0] if r[1] == 1 else -r[0]))):  # one customer's rows forwards, the other's backwards
        spark.createDataFrame([r], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / f"orders.parquet/part={i}"))
    got = {r["id"]: r for r in tables.customers(spark, str(tmp_path)).collect()}
    assert got[1]["spend"] == got[2]["spend"] == (0.1 + 0.2 + 0.3) / 1e6
    assert got[1]["avg_price"] == (0.1 + 0.2 + 0.3) / 3 and got[1]["n_f"] == 3 and got[2]["n_orders"] == 3
    assert (got[3]["spend"], got[3]["n_orders"], got[3]["n_f"], got[3]["avg_price"]) == (0, 0, 0, 0)
