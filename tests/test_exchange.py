"""The packed exchange, multinomial bootstrap, blocked moments and stateless refits against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resampla.operators import bootstrap, confounding, linear, logistic, resample
from resampla.plans import exchange
from resampla.plans import frame as frame_module
from resampla.plans.frame import Moments, moments, prepare


def numbered(spark, x, names):
    rows = [(i + 1, *map(float, r)) for i, r in enumerate(np.column_stack(x))]
    return spark.createDataFrame(rows, "rid long, " + ", ".join(f"{n} double" for n in names))


def test_permutations_run_backwards():
    for n in (1, 2, 9, 1000, 2**31 + 7):
        rid = np.unique(np.linspace(1, n, 300).astype(np.int64))
        for rep in (1, 5):
            assert (resample.origins(resample.positions(rid, n, 3, "x", rep), n, 3, "x", rep) == rid).all()


@pytest.mark.parametrize("n,per,width", [(1, 5, 3), (23, 5, 1), (100, 7, 2), (100, 200, 50)])
def test_values_arrive_where_the_permutation_sends_them(spark, monkeypatch, n, per, width):
    r = np.random.default_rng(n)
    a, b, c = r.normal(size=(3, n))
    frame = numbered(spark, [a, b, c], "abc")
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 8 * per * 3 * width)
    monkeypatch.setattr(exchange, "FAN", 3)
    packed = exchange.pack(frame.repartition(3), n, {k: F.col(k) for k in "abc"}, per)
    weight = np.arange(1, n + 1) ** 2.0

    def sums(reps, pos, moved, held):
        w = pos**2.0
        return np.stack([(moved[0][0] * w).sum(1), (moved[0][1] * w).sum(1), (moved[1][0] * held[0]).sum(1), np.full(len(reps), held[0].sum())], 1)

    got = {}
    for row in exchange.exchanged(packed, [exchange.Channel("one", ["a", "b"]), exchange.Channel("two", ["c"])], ["a"], 5, 9, sums).collect():
        for i, s in enumerate(np.frombuffer(row["state"]).reshape(-1, 4)):
            got[row["first"] + i] = s
    rid = np.arange(1, n + 1)
    assert sorted(got) == [1, 2, 3, 4, 5]
    for rep, s in got.items():
        one, two = (resample.positions(rid, n, 9, k, rep) for k in ("one", "two"))
        moved = np.empty(n)
        moved[two - 1] = c
        want = [(a * weight[one - 1]).sum(), (b * weight[one - 1]).sum(), (moved * a).sum(), a.sum()]
        assert s == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_a_test_of_300000_rows_needs_no_row_join(spark):
    n = 300_000
    r = np.random.default_rng(6)
    x, z = r.normal(size=(2, n))
    y = 0.01 * x + z + r.normal(size=n)
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"rid": np.arange(1, n + 1), "x": x, "z": z, "y": y})).persist()
    m = moments(rows, ["x", "z", "y"])
    null = linear.ter_braak(rows, m, ["x", "z"], "y", 3, 11)
    plan = null._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    got = {(s["rep"], s["feature"]): s["stat"] for s in null.collect()}
    rid, one = np.arange(1, n + 1), np.ones(n)
    for (name, own, other), rep in itertools.product((("x", x, z), ("z", z, x)), (1, 3)):
        a = np.c_[one, other]
        e, u = (v - a @ np.linalg.lstsq(a, v, rcond=None)[0] for v in (y, own))
        moved = np.empty(n)
        moved[resample.positions(rid, n, 11, name, rep) - 1] = e
        assert got[rep, name] == pytest.approx(u @ moved / (u @ u), abs=1e-10)
    rows.unpersist()


def test_all_features_take_one_scan(spark):
    r = np.random.default_rng(2)
    frame = numbered(spark, list(r.normal(size=(7, 60))), "abcdefy")
    m = moments(frame, list("abcdefy"))
    for null in (linear.ter_braak(frame, m, list("abcdef"), "y", 4, 1), linear.kennedy(frame, m, list("abcdef"), "y", ["a"], 4, 1)):
        assert null._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


# ---------------------------------------------------------------- bootstrap


def test_log_gamma():
    x = np.r_[1.0, 1.5, 2, 9.99, 10, 1e3, 123456.5, 1e9]
    assert bootstrap.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-11)


@pytest.mark.parametrize("m,share", [(3, 0.5), (15, 0.3), (40, 0.5), (1000, 0.49), (1000, 0.6), (10**7, 0.5)])
def test_binomials_have_their_distribution(m, share):
    s = bootstrap.streams(5, range(1, 4001))
    k = bootstrap.binomial(s, 77, np.full(4000, m), share)
    mean, sd = m * share, math.sqrt(m * share * (1 - share))
    assert k.min() >= 0 and k.max() <= m
    assert abs(k.mean() - mean) < 4 * sd / math.sqrt(4000) and abs(k.std() / sd - 1) < 0.05
    if m <= 1000:  # Kolmogorov distance from the exact distribution function
        pmf = np.array([math.comb(m, i) * share**i * (1 - share) ** (m - i) for i in range(m + 1)]) if m <= 40 else np.exp([math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(share) + (m - i) * math.log(1 - share) for i in range(m + 1)])
        seen = np.cumsum(np.bincount(k, minlength=m + 1)) / 4000
        assert abs(seen - np.cumsum(pmf)).max() < 1.7 / math.sqrt(4000)


def test_counts_are_whole_wherever_they_are_made():
    n, reps = 1000, range(1, 31)
    s = bootstrap.streams(1, reps)
    whole = np.concatenate([w for _, w in sorted(bootstrap.counts(s, n, 0, n), key=lambda x: x[0])], 1)
    assert whole.shape == (30, n) and (whole.sum(1) == n).all()
    for lo, hi in ((0, 10), (37, 400), (999, 1000)):
        part = np.concatenate([w for _, w in bootstrap.counts(s, n, lo, hi)], 1)
        assert (part == whole[:, lo:hi]).all()
    many = np.concatenate([w for _, w in bootstrap.counts(bootstrap.streams(2, range(1, 2001)), 300, 0, 300)], 1)
    share = np.bincount(many.ravel(), minlength=5)[:5] / many.size
    assert share == pytest.approx([math.comb(300, k) * (1 / 300) ** k * (299 / 300) ** (300 - k) for k in range(5)], abs=0.004)
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.25


def test_mediation_of_100_predictors(spark):
    r = np.random.default_rng(8)
    n, p, count = 150, 100, 21
    x = r.normal(size=(p, n)) + r.normal(size=n)
    y = x[:3].sum(0) + r.normal(size=n)
    names = [f"x{i}" for i in range(p)]
    frame = numbered(spark, [*x, y], [*names, "y"])
    m = moments(frame, [*names, "y"])
    pairs = [(a, b) for a in names for b in names if a != b]
    got = {(g["predictor"], g["mediator"]): g for g in confounding.mediate(frame, m, "y", pairs, count, 0.9, 4).collect()}
    assert len(got) == p * (p - 1)
    w = np.concatenate([c for _, c in bootstrap.counts(bootstrap.streams(4, range(1, count + 1)), n, 0, n)], 1)
    for a, b in (("x0", "x1"), ("x7", "x99"), ("x50", "x2")):
        i, j = int(a[1:]), int(b[1:])
        prod = []
        for times in w:
            rows = np.repeat(np.arange(n), times)
            one = np.ones(n)
            slope = np.linalg.lstsq(np.c_[one, x[i][rows]], x[j][rows], rcond=None)[0][1]
            prod.append(slope * np.linalg.lstsq(np.c_[one, x[i][rows], x[j][rows]], y[rows], rcond=None)[0][2])
        lo, hi = np.percentile(prod, [5, 95])
        assert (got[a, b]["ci_lower"], got[a, b]["ci_upper"]) == pytest.approx((lo, hi), abs=1e-9)


def test_a_constant_mediator_has_no_effect(spark):
    frame = numbered(spark, [np.arange(30.0), np.ones(30), np.arange(30.0) % 4], ["a", "k", "y"])
    row = confounding.mediate(frame, moments(frame, ["a", "k", "y"]), "y", [("a", "k"), ("k", "a")], 9).orderBy("predictor").collect()
    assert row[0]["b_path"] is None and row[0]["ci_lower"] is None and row[0]["is_mediator"] is False and row[1]["total_effect"] is None


# ---------------------------------------------------------------- moments and refits


def test_moments_of_1000_columns(spark, monkeypatch):
    r = np.random.default_rng(4)
    n, p = 500, 1000
    x = r.normal(size=(n, p)) * r.uniform(0.1, 9, p) + 1e6
    monkeypatch.setattr(frame_module, "ROWS", 64)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(5).select(*[F.get("v", F.lit(i)).alias(f"c{i}") for i in range(p)])
    got = moments(df, df.columns)
    assert got.n == n and [got.mean[c] for c in df.columns] == pytest.approx(x.mean(0), rel=1e-12)
    assert np.allclose(got.cov, np.cov(x.T, bias=True), rtol=1e-7, atol=1e-9)
    none = moments(df.limit(0), df.columns)
    assert none.n == 0 and isinstance(none, Moments)


def many(spark, n=700):
    r = np.random.default_rng(12)
    a, c = r.normal(size=(2, n))
    b = 0.6 * a + r.normal(size=n)
    y = (r.random(n) < 1 / (1 + np.exp(-0.4 * a + 0.3))).astype(float)
    frame = numbered(spark, [a, b, c, y], ["a", "b", "c", "y"])
    return frame, moments(frame, ["a", "b", "c", "y"]), ["a", "b", "c"]


def test_models_fitted_together_equal_single_fits(spark):
    frame, m, x = many(spark)
    sets = [["a"], ["b", "c"], [], ["a", "b", "c"]]
    for on, beta in zip(sets, logistic.fits(frame, m, "y", sets)):
        assert beta == pytest.approx(logistic.fit(frame, m, "y", on)["beta"], abs=1e-8)
    split = numbered(spark, [np.arange(20.0), (np.arange(20) > 9).astype(float)], ["a", "y"])
    with pytest.raises(logistic.SeparationError):
        logistic.fits(split, moments(split, ["a", "y"]), "y", [["a"]])


@pytest.mark.parametrize("method", ["ter_braak", "kennedy", "kennedy_joint"])
def test_stateless_steps_equal_refits_in_place(spark, monkeypatch, method):
    frame, m, x = many(spark)
    extra = {"ter_braak": (), "kennedy": (["c"],), "kennedy_joint": (["c"],)}[method]

    def go():
        out = getattr(logistic, method)(frame, m, x, "y", *extra, 5, 3)
        observed, rows = out if method == "kennedy_joint" else (0, out)
        return observed, {(r["rep"], r["feature"] if "feature" in rows.columns else ""): (r["stat"] if "stat" in rows.columns else r["improvement"], r["sound"]) for r in rows.collect()}

    near = go()
    monkeypatch.setattr(logistic, "FEW_ROWS", 100)
    monkeypatch.setattr(exchange, "LEAST", 64)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 8 * 88 * 3 * 2)
    far = go()
    assert far[0] == pytest.approx(near[0]) and far[1].keys() == near[1].keys()
    for k, (stat, sound) in near[1].items():
        assert far[1][k][0] == pytest.approx(stat, abs=1e-7) and far[1][k][1] == sound is True
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def steep(spark, n=700):
    """Slopes far from those of any replicate, on columns with a long tail."""
    r = np.random.default_rng(5)
    a, c = r.exponential(size=(2, n)) ** 2
    y = (r.random(n) < 1 / (1 + np.exp(4 - 4 * a - 2 * c))).astype(float)
    frame = numbered(spark, [a, c, y], ["a", "c", "y"])
    return frame, moments(frame, ["a", "c", "y"]), ["a", "c"]


@pytest.mark.parametrize("method", ["ter_braak", "kennedy", "kennedy_joint"])
def test_steps_settle_far_from_the_observed_slopes(spark, monkeypatch, method):
    frame, m, x = steep(spark)
    extra = {"ter_braak": (), "kennedy": (["c"],), "kennedy_joint": ([],)}[method]

    def go():
        out = getattr(logistic, method)(frame, m, x, "y", *extra, 5, 3)
        rows = out[1] if method == "kennedy_joint" else out
        return {(r["rep"], r["feature"] if "feature" in rows.columns else ""): (r["stat"] if "stat" in rows.columns else r["improvement"], r["sound"]) for r in rows.collect()}

    near = go()
    monkeypatch.setattr(logistic, "FEW_ROWS", 100)
    far = go()
    assert all(sound for _, sound in near.values()) and far.keys() == near.keys()
    for k, (stat, _) in near.items():
        assert far[k][1] and far[k][0] == pytest.approx(stat, abs=1e-6)


def test_prepared_rows_feed_the_exchange(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), float(i * i % 7)) for i in range(50)], "id string, a double, y double")
    frame = prepare(df, "id", ["a"], "y")
    packed = exchange.pack(frame, 50, {"a": F.col("a")}, 16)
    data = {r["range"]: np.frombuffer(r["data"]) for r in packed.frame.collect()}
    want = [r["a"] for r in frame.orderBy("rid").collect()]
    assert sorted(data) == [0, 1, 2, 3] and np.concatenate([data[i] for i in range(4)]).tolist() == want


def test_nearly_dependent_columns_equal_a_dense_solve(spark):
    """Condition 1e7: slopes, errors, residuals and both tests."""
    r = np.random.default_rng(9)
    n = 400
    a, c, e = r.normal(size=(3, n))
    b = a + 2e-7 * e
    y = a - c + r.normal(size=n)
    x = np.c_[a, b, c]
    z = x - x.mean(0)
    assert 5e6 < np.linalg.cond(z) < 5e7
    frame = numbered(spark, [a, b, c, y], ["a", "b", "c", "y"]).repartition(7)
    m = moments(frame, ["a", "b", "c", "y"])
    want = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    got = linear.coefficients(m, ["a", "b", "c"], "y")
    assert [g["coef"] for g in got] == pytest.approx(want, rel=1e-8)
    left = y - y.mean() - z @ want
    se = np.sqrt(left @ left / (n - 4) * np.diag(np.linalg.inv(np.linalg.qr(z, "r")) @ np.linalg.inv(np.linalg.qr(z, "r")).T))
    assert [g["se"] for g in got] == pytest.approx(se, rel=1e-7) and m.rss("y", ["a", "b", "c"]) == pytest.approx(left @ left, rel=1e-10)
    seen = {k["rid"]: k["residual"] for k in linear.fitted(frame, m, "y", ["a", "b", "c"]).collect()}
    assert [seen[i + 1] for i in range(n)] == pytest.approx(left, abs=1e-7)
    rid = np.arange(1, n + 1)
    null = {(k["rep"], k["feature"]): k["stat"] for k in linear.kennedy(frame, m, ["a", "b", "c"], "y", [], 3, 2).collect()}
    for j, name in enumerate("abc"):
        for rep in (1, 3):
            w = z.copy()
            w[resample.positions(rid, n, 2, name, rep) - 1, j] = z[:, j]
            assert null[rep, name] == pytest.approx(np.linalg.lstsq(w, y - y.mean(), rcond=None)[0][j], rel=1e-6)
    with pytest.raises(frame_module.CollinearFeatureError):
        twin = frame.withColumn("d", F.col("a") - 2 * F.col("c"))
        moments(twin, ["a", "c", "d", "y"]).fit("y", ["a", "c", "d"])


def test_bootstrap_of_more_rows_than_small_leaves_hold_equals_sql():
    import duckdb

    from resampla import catalog
    from resampla.operators import bootstrap

    n = 600_000
    want = duckdb.sql(f"with fr as (select range + 1 as rid from range({n})), {catalog.boot_sql(1)} select rid, count(*) as times from bi where rid <= 2000 group by rid order by rid").fetchall()
    got = [(first + 1 + i, int(w[0, i])) for first, w in bootstrap.counts(bootstrap.streams(catalog.SEED, [1]), n, 0, 2000) for i in np.flatnonzero(w[0])]
    assert sorted(got) == want
    whole = np.concatenate([w[0] for _, w in bootstrap.counts(bootstrap.streams(catalog.SEED, [1]), n, 0, n)])
    assert len(whole) == n and whole.sum() == n


def test_ter_braak_moves_values_once_whatever_the_steps(spark, monkeypatch):
    """Only outcomes differ between its refits, so their products with the columns are all that steps need of them."""
    frame, m, x = many(spark)
    monkeypatch.setattr(logistic, "FEW_ROWS", 100)
    monkeypatch.setattr(exchange, "LEAST", 64)
    monkeypatch.setattr(logistic, "CHUNK", 50)
    monkeypatch.setattr(logistic, "MODELS", 4)
    calls, plain = [], exchange.exchanged
    monkeypatch.setattr(exchange, "exchanged", lambda *a, **k: calls.append(1) or plain(*a, **k))
    far = {(r["rep"], r["feature"]): r for r in logistic.ter_braak(frame, m, x, "y", 7, 3).collect()}
    assert len(calls) == 1 and len(far) == 21
    monkeypatch.setattr(logistic, "FEW_ROWS", 10_000)
    for r in logistic.ter_braak(frame, m, x, "y", 7, 3).collect():
        assert far[r["rep"], r["feature"]]["stat"] == pytest.approx(r["stat"], abs=1e-8) and far[r["rep"], r["feature"]]["sound"] == r["sound"] is True


def test_outcomes_of_one_class_are_not_sound(spark):
    frame, m, x = many(spark)
    packed = exchange.pack(frame, m.n, {c: F.col(c) for c in "abc"}, 64)
    outcome = lambda i, reps, pos, moved, held: np.where((reps == 2)[:, None], 0.0, np.broadcast_to(pos % 2.0, (len(reps), len(pos))))
    _, sound = logistic.stepped_outcomes(packed, [exchange.Channel("k", ["a"])], x, [], 3, 1, 1, outcome)
    assert sound.tolist() == [[True, False, True]]
