"""Least squares: observed model, diagnostics, and permutation tests without refits.

By the Frisch-Waugh-Lovell theorem a refitted coefficient is a ratio of sums over residuals, so a replicate is a few sums
instead of a model; values meet their permuted positions by the exchange of ``plans.exchange``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.functions import tails
from resampla.plans import exchange
from resampla.plans.frame import CollinearFeatureError, Moments, linear, moments, residual


def coefficients(m: Moments, features: list[str], target: str) -> list[dict]:
    """Observed slopes with standard errors, t statistics and two-sided p-values."""
    _, beta = m.fit(target, features)
    df = m.n - len(features) - 1
    s2 = max(m.rss(target, features), 0.0) / df if df > 0 else math.nan
    inverse = m.inverse(features)
    out = []
    for i, c in enumerate(features):
        se = float(math.sqrt(s2 * inverse[i, i])) if df > 0 else math.nan
        t = float(beta[i]) / se if se else math.inf
        out.append({"feature": c, "ordinal": i, "coef": float(beta[i]), "se": se, "stat": float(t), "p_classic": tails.t_two_sided(t, df)})
    return out


def diagnostics(m: Moments, features: list[str], target: str) -> dict:
    """R squared and its adjusted form, F and its p-value, AIC and BIC."""
    n, p = m.n, len(features)
    tss, rss = n * m.block([target], [target])[0, 0], m.rss(target, features)
    r2 = 1 - rss / tss if tss else math.nan
    f = (tss - rss) / p / (rss / (n - p - 1)) if n > p + 1 and rss > 0 else math.nan
    llf = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.nan
    return {
        "n_observations": n, "n_features": p, "r_squared": r2, "r_squared_adj": 1 - (1 - r2) * (n - 1) / (n - p - 1) if n > p + 1 else math.nan,
        "f_statistic": f, "f_p_value": tails.f_upper(f, p, n - p - 1), "aic": 2 * (p + 1) - 2 * llf, "bic": (p + 1) * math.log(n) - 2 * llf,
    }


def scaled(m: Moments, columns: list[str]) -> dict[str, Column]:
    """Centred columns of unit variance."""
    scale = {c: math.sqrt(m.block([c], [c])[0, 0]) for c in columns}
    if any(s == 0 for s in scale.values()):
        raise CollinearFeatureError(f"constant: {[c for c in columns if scale[c] == 0]}")
    return {c: (F.col(c) - F.lit(m.mean[c])) / F.lit(scale[c]) for c in columns}


def correlations(m: Moments, columns: list[str]) -> np.ndarray:
    """n times the correlation matrix: the sums of products of scaled columns."""
    a = m.block(columns, columns)
    scale = np.sqrt(np.diag(a))
    return m.n * a / np.outer(scale, scale)


def feature_rows(reps: np.ndarray, names: list[str], stats: np.ndarray):
    for name, stat in zip(names, stats):
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([name] * len(reps)), pa.array(stat, from_pandas=True)], names=["rep", "feature", "stat"])


def ter_braak(frame: DataFrame, m: Moments, features: list[str], target: str, count: int, seed: int) -> DataFrame:
    """(rep, feature, stat): refitted slopes after permuting the residuals of the model without the feature.

    A single feature's reduced model is the mean alone.  All features go through one exchange.
    """
    columns, below = {}, []
    for i, c in enumerate(features):
        rest = [x for x in features if x != c]
        columns |= {f"e{i}": residual(m, target, rest), f"x{i}": residual(m, c, rest)}
        below.append(m.rss(c, rest))
    packed = exchange.pack(frame, m.n, columns)

    def sums(reps, pos, moved, held):
        return np.stack([e[0] @ x for e, x in zip(moved, held)], 1)

    states = exchange.exchanged(packed, [exchange.Channel(c, [f"e{i}"]) for i, c in enumerate(features)], [f"x{i}" for i in range(len(features))], count, seed, sums)
    return exchange.replicate_rows(states, len(features), lambda reps, s: feature_rows(reps, features, (s / below).T), "rep long, feature string, stat double")


def kennedy(frame: DataFrame, m: Moments, features: list[str], target: str, confounders: list[str], count: int, seed: int) -> DataFrame:
    """(rep, feature, stat): slopes of each feature whose residuals given the confounders are permuted, all others kept.

    From the sums of a feature's moved residuals with an orthonormal basis of all features and with the outcome: what they share with
    the other features leaves the residuals' own square and their product with the outcome.
    """
    tested = [c for c in features if c not in confounders]
    if not tested:
        return frame.sparkSession.createDataFrame([], "rep long, feature string, stat double")
    for c in tested:
        m.fit(target, [x for x in features if x != c])  # raises where the other features are dependent
    fixed = [*features, target]
    packed = exchange.pack(frame, m.n, {f"r{i}": residual(m, c, confounders) for i, c in enumerate(tested)} | {f"z{i}": z for i, z in enumerate(scaled(m, fixed).values())})
    k, triangle = len(features), m.triangle(fixed)
    turn = np.linalg.inv(triangle[:k, :k]).T  # from scaled features to the basis
    spread = math.sqrt(m.block([target], [target])[0, 0])
    own = [m.rss(c, confounders) for c in tested]

    def sums(reps, pos, moved, held):
        basis = np.concatenate([turn @ held[:k], held[k:]])
        return np.concatenate([r[0] @ basis.T for r in moved], 1)

    def finish(reps, s):
        stats = []
        for i, c in enumerate(tested):
            rest = [j for j in range(k) if features[j] != c]
            part = s[:, i * (k + 1) : (i + 1) * (k + 1)]
            others = np.linalg.qr(triangle[:k, rest])[0]  # the other features' span, in the basis
            shared = part[:, :k] @ others
            low = own[i] - (shared**2).sum(1)
            up = spread * (part[:, k] - shared @ (others.T @ triangle[:k, k]))
            stats.append(np.divide(up, low, out=np.full(len(reps), np.nan), where=low != 0))
        yield from feature_rows(reps, tested, np.array(stats))

    states = exchange.exchanged(packed, [exchange.Channel(c, [f"r{i}"]) for i, c in enumerate(tested)], [f"z{i}" for i in range(k + 1)], count, seed, sums)
    return exchange.replicate_rows(states, len(tested) * (k + 1), finish, "rep long, feature string, stat double")


def kennedy_joint(frame: DataFrame, m: Moments, features: list[str], target: str, confounders: list[str], count: int, seed: int) -> tuple[float, DataFrame]:
    """Observed fall of the residual sum of squares by all features beside the confounders, and (rep, improvement) after permuting rows of their residuals."""
    tested = [x for x in features if x not in confounders]
    if not tested:
        raise ValueError("every feature is a confounder: nothing is left to test")
    observed = m.rss(target, confounders) - m.rss(target, features)
    k, q = len(tested), len(confounders)
    columns = {f"x{i}": residual(m, c, confounders) for i, c in enumerate(tested)} | {"y": residual(m, target, confounders)} | {f"z{i}": z for i, z in enumerate(scaled(m, confounders).values())}
    packed = exchange.pack(frame, m.n, columns)
    inner = correlations(m, confounders) if q else np.zeros((0, 0))
    own = m.block(tested, tested) - (m.block(tested, confounders) @ np.linalg.solve(m.block(confounders, confounders), m.block(confounders, tested)) if q else 0.0)
    gram = m.n * own

    def sums(reps, pos, moved, held):
        return np.einsum("krn,fn->rkf", moved[0], held).reshape(len(reps), -1)

    def finish(reps, s):
        s = s.reshape(len(reps), k, q + 1)
        c, shared = s[:, :, 0], s[:, :, 1:]
        left = gram - shared @ np.linalg.solve(inner, shared.transpose(0, 2, 1)) if q else np.broadcast_to(gram, (len(reps), k, k))
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array((c * np.linalg.solve(left, c[..., None])[..., 0]).sum(1))], names=["rep", "improvement"])

    states = exchange.exchanged(packed, [exchange.Channel("joint", [f"x{i}" for i in range(k)])], ["y", *[f"z{i}" for i in range(q)]], count, seed, sums)
    return float(observed), exchange.replicate_rows(states, k * (q + 1), finish, "rep long, improvement double")


def fitted(frame: DataFrame, m: Moments, target: str, on: list[str]) -> DataFrame:
    """(rid, fitted, residual) of one column on others."""
    return frame.select("rid", linear(*m.fit(target, on), on).alias("fitted"), residual(m, target, on).alias("residual"))


__all__ = ["coefficients", "diagnostics", "fitted", "kennedy", "kennedy_joint", "moments", "ter_braak"]
