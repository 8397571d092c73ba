"""Logistic regression by Newton steps: one aggregation over the rows per step, and refits of all replicates that keep nothing between steps."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.functions import tails
from resampla.operators import resample
from resampla.operators.linear import scaled
from resampla.plans import exchange
from resampla.plans.frame import CollinearFeatureError, Moments, linear, residual

EPS = 2.220446049250313e-16  # fixed value: probabilities are kept this far from 0 and 1 in the deviance
STEPS = 30  # Newton steps of a replicate, in both plans
CHUNK, MODELS = 4096, 32  # rows and models that a pass works on at a time
FEW_ROWS = 20_000  # up to which a replicate is fitted where it lies, without an exchange


class SeparationError(ValueError):
    """The outcome is separated: the likelihood has no maximum."""


def probability(beta, columns: list[str]) -> Column:
    return 1 / (1 + F.exp(-linear(beta[0], beta[1:], columns)))


def fit(frame: DataFrame, m: Moments, target: str, on: list[str], steps: int = 60) -> dict:
    """Maximum likelihood slopes (intercept first), their covariance and the log likelihood.

    Columns are centred and scaled inside, so the Hessian stays well conditioned.
    """
    k = len(on) + 1
    scale = {c: math.sqrt(m.block([c], [c])[0, 0]) for c in on}
    if any(s == 0 for s in scale.values()):
        raise CollinearFeatureError(f"constant: {[c for c in on if scale[c] == 0]}")
    if on and np.linalg.eigvalsh(m.block(on, on) / np.outer(list(scale.values()), list(scale.values())))[0] < 1e-10:
        raise CollinearFeatureError(f"linearly dependent: {on}")
    z = [F.lit(1.0)] + [(F.col(c) - m.mean[c]) / scale[c] for c in on]
    beta = np.zeros(k)
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, z)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        w, r = p * (1 - p), F.col(target) - p
        ll = F.sum(F.col(target) * F.log(F.greatest(p, F.lit(EPS))) + (1 - F.col(target)) * F.log(F.greatest(1 - p, F.lit(EPS))))
        far = F.max(F.abs(r))
        row = frame.agg(ll.alias("ll"), far.alias("far"), *[F.sum(r * z[i]).alias(f"g{i}") for i in range(k)], *[F.sum(w * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if row["far"] < 1e-8:
            raise SeparationError("the outcome is separated by the features")
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        try:
            step = np.linalg.solve(h, [row[f"g{i}"] for i in range(k)])
        except np.linalg.LinAlgError:
            raise SeparationError("the likelihood has no maximum") from None
        if np.abs(step).max() < 1e-10:
            break
        beta = beta + step * min(1.0, 5.0 / np.abs(step).max())
    else:
        raise SeparationError("the likelihood has no maximum")
    turn = np.eye(k)  # from centred and scaled columns back to the given ones
    for i, c in enumerate(on, 1):
        turn[i, i] = 1 / scale[c]
        turn[0, i] = -m.mean[c] / scale[c]
    return {"beta": turn @ beta, "cov": turn @ np.linalg.inv(h) @ turn.T, "ll": row["ll"]}


def newton_sums(y: np.ndarray, x: list[np.ndarray], beta: np.ndarray) -> np.ndarray:
    """Deviance, gradient and upper Hessian of models (models x (1 + k + k (k + 1) / 2)): rows of ``beta``, outcomes and columns either shared by them or a row each."""
    eta = beta[:, :1] + sum((b[:, None] * c for b, c in zip(beta.T[1:], x)), 0.0)
    p = 1 / (1 + np.exp(-np.clip(eta + np.zeros(np.shape(y)[-1]), -500, 500)))
    q = np.clip(p, EPS, 1 - EPS)
    out = [-2 * (y * np.log(q) + (1 - y) * np.log(1 - q)).sum(1)]
    r, w = y - p, p * (1 - p)
    out += [r.sum(1), *((r * c).sum(1) for c in x)]
    for i, a in enumerate([None, *x]):
        wa = w if a is None else w * a
        out += [wa.sum(1) if c is None else (wa * c).sum(1) for c in [None, *x][i:]]
    return np.stack(out, 1)


def newton_step(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviances, steps and Hessians from ``newton_sums``."""
    i, j = np.triu_indices(k)
    h = np.zeros((len(sums), k, k))
    h[:, i, j] = h[:, j, i] = sums[:, 1 + k :]
    return sums[:, 0], np.linalg.solve(h + 1e-12 * np.eye(k), sums[:, 1 : 1 + k, None])[..., 0], h


def fits(frame: DataFrame, m: Moments, target: str, sets: list[list[str]], steps: int = 60) -> list[np.ndarray]:
    """Maximum likelihood slopes (intercept first) of one outcome on several sets of columns: all models step together, one aggregation a step."""
    columns = sorted({c for on in sets for c in on})
    packed = exchange.pack(frame, m.n, scaled(m, columns) | {target: F.col(target)})
    packed.frame = packed.frame.persist()  # n rows, read once a step
    at = {c: i for i, c in enumerate(packed.columns)}
    beta, live, width = [np.zeros(len(on) + 1) for on in sets], set(range(len(sets))), [1 + k + k * (k + 1) // 2 for k in (len(on) + 1 for on in sets)]
    try:
        for _ in range(steps):
            now = [b.copy() for b in beta]
            todo = sorted(live)
            state = exchange.summed(packed, lambda data: np.concatenate([newton_sums(data[at[target]], [data[at[c]] for c in sets[i]], now[i][None])[0] for i in todo]))
            for i, part in zip(todo, np.split(state, np.cumsum([width[i] for i in todo])[:-1])):
                _, step, _ = newton_step(part[None], len(beta[i]))
                size = np.abs(step[0]).max()
                if not np.isfinite(size) or np.abs(beta[i]).max() > 50:
                    raise SeparationError("the likelihood has no maximum")
                if size < 1e-10:
                    live.discard(i)
                else:
                    beta[i] = beta[i] + step[0] * min(1.0, 5.0 / size)
            if not live:
                break
        else:
            raise SeparationError("the likelihood has no maximum")
    finally:
        packed.frame.unpersist()
    out = []
    for on, b in zip(sets, beta):
        own = b.copy()
        own[1:] /= [math.sqrt(m.block([c], [c])[0, 0]) for c in on]
        own[0] -= sum(s * m.mean[c] for s, c in zip(own[1:], on))
        out.append(own)
    return out


def coefficients(model: dict, features: list[str]) -> list[dict]:
    """Slopes with Wald z statistics and two-sided p-values."""
    out = []
    for i, c in enumerate(features):
        b, se = float(model["beta"][i + 1]), math.sqrt(model["cov"][i + 1, i + 1])
        out.append({"feature": c, "ordinal": i, "coef": b, "se": se, "stat": b / se, "p_classic": tails.z_two_sided(b / se)})
    return out


def diagnostics(model: dict, m: Moments, features: list[str], target: str) -> dict:
    """McFadden's R squared, log likelihoods, their ratio's p-value, AIC and BIC."""
    n, p, q = m.n, len(features), m.mean[target]
    null = n * (q * math.log(q) + (1 - q) * math.log(1 - q))
    return {
        "n_observations": n, "n_features": p, "pseudo_r_squared": 1 - model["ll"] / null, "log_likelihood": model["ll"], "log_likelihood_null": null,
        "llr_p_value": tails.chi2_upper(2 * (model["ll"] - null), p), "aic": 2 * (p + 1) - 2 * model["ll"], "bic": (p + 1) * math.log(n) - 2 * model["ll"],
    }


def deviance(frame: DataFrame, target: str, p: Column) -> float:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return frame.agg((-2 * F.sum(F.col(target) * F.log(q) + (1 - F.col(target)) * F.log(1 - q))).alias("d")).first()["d"]


def newton(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, bool]:
    """Slopes (intercept first), deviance and soundness of one logistic fit."""
    a = np.c_[np.ones(len(y)), x]
    mid, scale = a.mean(0), a.std(0)
    mid[0], scale[0] = 0, 1
    if (scale == 0).any() or not 0 < y.mean() < 1:
        return np.full(a.shape[1], np.nan), np.nan, False
    a = (a - mid) / scale
    b, sound = np.zeros(a.shape[1]), False
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        try:
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-12 * np.eye(len(b)), a.T @ (y - p))
        except np.linalg.LinAlgError:
            break
        size = np.abs(step).max()
        if not np.isfinite(size) or np.abs(b).max() > 50:
            break
        if size < 1e-8:
            sound = True
            break
        b = b + step * min(1, 5 / size)
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ b, -500, 500))), 2.2e-16, 1 - 2.2e-16)
    out = b / scale
    out[0] -= out[1:] @ mid[1:]
    return out, float(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), sound


def whole_replicates(moved: DataFrame, y: str, on: list[str]) -> DataFrame:
    """(rep, beta array, deviance, sound) of replicates that each lie in one partition, as ``resample.permuted`` leaves them while rows are few: no shuffle, one task fits many."""

    def run(batches):
        held, key = [], None

        def close():
            a = np.concatenate(held)
            beta, deviance, sound = newton(a[:, 1:], a[:, 0])
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([beta[1:].tolist()], pa.list_(pa.float64())), pa.array([deviance]), pa.array([sound])], names=["rep", "beta", "deviance", "sound"])

        for b in batches:
            reps = b.column(0).to_numpy()
            a = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            cut = np.r_[0, np.flatnonzero(reps[1:] != reps[:-1]) + 1, len(reps)] if len(reps) else []
            for s, e in zip(cut[:-1], cut[1:]):
                if held and reps[s] != key:
                    yield close()
                    held.clear()
                key = int(reps[s])
                held.append(a[s:e])
        if held:
            yield close()

    ready = moved.select("rep", F.col(y).cast("double"), *on).sortWithinPartitions("rep")
    return ready.mapInArrow(run, "rep long, beta array<double>, deviance double, sound boolean")


def moved_on(beta: np.ndarray, sound: np.ndarray, live: np.ndarray, i: int, r: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The deviances of model ``i`` in replicates ``r``, whose slopes take a step in place; those that settle or are lost are no longer live."""
    dev, step, _ = newton_step(sums, beta.shape[2])
    size = np.abs(step).max(1)
    lost = ~np.isfinite(size) | (np.abs(beta[i, r]).max(1) > 50)
    settled = size < 1e-8
    sound[i, r[lost]] = False
    beta[i, r] += np.where((settled | lost)[:, None], 0, step * np.minimum(1, 5 / np.maximum(size, 1e-300))[:, None])
    live[i, r[settled | lost]] = False
    return dev


def stepped(packed: exchange.Packed, channels: list[exchange.Channel], fixed: list[str], count: int, seed: int, models: int, k: int, design: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slopes: models x replicates x k, intercept first, in scaled columns; deviances; sound) of several models refitted in every replicate.

    All step together.  Each step moves the values anew, from positions computed anew: nothing of replicates x rows is kept.  What
    reaches the driver is a gradient and a Hessian of each.  ``design(model, reps, pos, moved, held)`` gives the outcome and the columns.
    A replicate with one class, or whose steps don't settle, is not sound.  As for ``newton``, steps start at zero: from the
    observed slopes, which a replicate's own may be far from, steps of up to five can swing around the maximum for good.
    """
    width = 1 + k + k * (k + 1) // 2
    beta = np.zeros((models, count, k))
    sound, live, dev = np.ones((models, count), bool), np.ones((models, count), bool), np.full((models, count), np.nan)
    packed.frame = packed.frame.persist()  # n rows
    try:
        for _ in range(STEPS):
            now, open_ = beta.copy(), live.copy()

            def sums(reps, pos, moved, held):
                out = np.zeros((len(reps), models * width))
                for i in range(models):
                    at = np.flatnonzero(open_[i, reps - 1])
                    if len(at):
                        y, x = design(i, reps, pos, moved, held)
                        pick = lambda c: c[at] if np.ndim(c) == 2 else c
                        out[at, i * width : (i + 1) * width] = newton_sums(pick(y), [pick(c) for c in x], now[i, reps[at] - 1])
                return out

            for row in exchange.exchanged(packed, channels, fixed, count, seed, sums, live.any(0)).collect():
                state = np.frombuffer(row["state"], np.float64).reshape(-1, models, width)
                reps = row["first"] - 1 + np.arange(len(state))
                for i in range(models):
                    at = np.flatnonzero(live[i, reps])
                    if len(at):
                        dev[i, reps[at]] = moved_on(beta, sound, live, i, reps[at], state[at, i])
            if not live.any():
                break
    finally:
        packed.frame.unpersist()
    return beta, dev, sound & ~live


def curves(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sums of p times each column (1 first) and upper Hessian (models x (k + k (k + 1) / 2)) of models of the same columns: rows of ``beta``."""
    k = beta.shape[1]
    i, j = np.triu_indices(k)
    out = np.zeros((len(beta), k + len(i)))
    for lo in range(0, x.shape[1], CHUNK):
        here = x[:, lo : lo + CHUNK]
        z = np.concatenate([np.ones((1, here.shape[1])), here])
        zz = (z[i] * z[j]).T
        for m in range(0, len(beta), MODELS):
            p = 1 / (1 + np.exp(-np.clip(beta[m : m + MODELS] @ z, -500, 500)))
            out[m : m + MODELS, :k] += p @ z.T
            out[m : m + MODELS, k:] += (p * (1 - p)) @ zz
    return out


def stepped_outcomes(packed: exchange.Packed, channels: list[exchange.Channel], features: list[str], fixed: list[str], count: int, seed: int, models: int, outcome: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, sound) as ``stepped`` gives them, of models whose outcomes alone differ between replicates.

    A gradient is the columns' products with the outcome less those with the probabilities.  The first don't follow the slopes, so
    values are moved once, for them; each step then passes over the rows as they lie, whose columns all models and replicates share.
    ``outcome(model, reps, pos, moved, held)`` gives the outcomes.
    """
    k = len(features) + 1
    beta = np.zeros((models, count, k))
    sound, live, met = np.ones((models, count), bool), np.ones((models, count), bool), np.zeros((models, count, k))
    packed.frame = packed.frame.persist()  # n rows
    at = [packed.columns.index(c) for c in features]
    try:

        def products(reps, pos, moved, held):
            z = np.concatenate([np.ones((1, len(pos))), held[: k - 1]]).T
            return np.concatenate([outcome(i, reps, pos, moved, held) @ z for i in range(models)], axis=1)

        for row in exchange.exchanged(packed, channels, [*features, *fixed], count, seed, products).collect():
            state = np.frombuffer(row["state"], np.float64).reshape(-1, models, k)
            met[:, row["first"] - 1 : row["first"] - 1 + len(state)] = state.transpose(1, 0, 2)
        for _ in range(STEPS):
            todo, now = np.nonzero(live), beta[live]
            state = exchange.summed(packed, lambda data: curves(data[at], now).ravel()).reshape(len(now), -1)
            state = np.concatenate([np.full((len(now), 1), np.nan), met[todo] - state[:, :k], state[:, k:]], axis=1)  # no deviances
            for i in range(models):
                own = todo[0] == i
                if own.any():
                    moved_on(beta, sound, live, i, todo[1][own], state[own])
            if not live.any():
                break
    finally:
        packed.frame.unpersist()
    return beta, sound & ~live


def stat_rows(spark, features: list[str], stats: np.ndarray, sound: np.ndarray) -> DataFrame:
    table = pa.table({"rep": np.tile(np.arange(1, stats.shape[1] + 1), len(features)), "feature": np.repeat(features, stats.shape[1]), "stat": stats.ravel(), "sound": sound.ravel()})
    return spark.createDataFrame(table)


def simulated_outcome(frame: DataFrame, m: Moments, features: list[str], target: str, feature: str, beta: np.ndarray, count: int, seed: int) -> DataFrame:
    """(rep, pos, y, features): permuted response residuals on the reduced model's probabilities, drawn as 0 or 1."""
    rest = [x for x in features if x != feature]
    p = probability(beta, rest)
    work = frame.select("rid", p.alias("p"), (F.col(target) - p).alias("e"), *features)
    moved = resample.permuted(work, m.n, count, seed, feature, ["e"], f"{feature}:draw")
    moved = resample.at_positions(moved, work.select("rid", "p", *features), m.n, ["p", *features])
    return moved.select("rep", "pos", resample.bernoulli(F.col("p") + F.col("e"), F.col("u")).alias("y"), *features)


def ter_braak(frame: DataFrame, m: Moments, features: list[str], target: str, count: int, seed: int) -> DataFrame:
    """(rep, feature, stat, sound).  Up to FEW_ROWS rows a replicate is fitted where it lies; beyond that all features' models of all replicates step together."""
    rests = [[x for x in features if x != c] for c in features]
    reduced = fits(frame, m, target, rests)
    if m.n <= FEW_ROWS:
        out = None
        for i, c in enumerate(features):
            moved = simulated_outcome(frame, m, features, target, c, reduced[i], count, seed)
            one = whole_replicates(moved, "y", features).select("rep", F.lit(c).alias("feature"), F.get("beta", F.lit(i)).alias("stat"), "sound")
            out = one if out is None else out.unionByName(one)
        return out
    k = len(features)
    columns = scaled(m, features)
    for i, (b, rest) in enumerate(zip(reduced, rests)):
        p = probability(b, rest)
        columns |= {f"_p{i}": p, f"_e{i}": F.col(target) - p}
    channels = [exchange.Channel(c, [f"_e{i}"]) for i, c in enumerate(features)]

    def outcome(i, reps, pos, moved, held):
        u = np.stack([resample.uniforms(pos, seed, f"{features[i]}:draw", int(r)) for r in reps])
        return (u < np.clip(held[k + i] + moved[i][0], 0.001, 0.999)).astype(float)

    beta, sound = stepped_outcomes(exchange.pack(frame, m.n, columns), channels, features, [f"_p{i}" for i in range(k)], count, seed, k, outcome)
    scale = [math.sqrt(m.block([c], [c])[0, 0]) for c in features]
    return stat_rows(frame.sparkSession, features, np.stack([beta[i, :, i + 1] / scale[i] for i in range(k)]), sound)


def kennedy(frame: DataFrame, m: Moments, features: list[str], target: str, confounders: list[str], count: int, seed: int) -> DataFrame:
    """(rep, feature, stat, sound): the feature is rebuilt from its fit on the confounders and permuted residuals."""
    tested = [c for c in features if c not in confounders]
    if not tested:
        return frame.sparkSession.createDataFrame([], "rep long, feature string, stat double, sound boolean")
    if m.n <= FEW_ROWS:
        out = None
        for c in tested:
            work = frame.select("rid", residual(m, c, confounders).alias("_r"))
            fixed = [*[x for x in features if x != c], target]
            moved = resample.at_positions(resample.permuted(work, m.n, count, seed, c, ["_r"]), frame.select("rid", *fixed), m.n, fixed)
            moved = moved.withColumn(c, linear(*m.fit(c, confounders), confounders) + F.col("_r"))
            one = whole_replicates(moved, target, features).select("rep", F.lit(c).alias("feature"), F.get("beta", F.lit(features.index(c))).alias("stat"), "sound")
            out = one if out is None else out.unionByName(one)
        return out
    packed, rebuilt, scale = rebuilt_columns(frame, m, features, target, tested, confounders)
    k = len(features)

    def design(i, reps, pos, moved, held):
        x = list(held[:k])
        x[features.index(tested[i])] = held[k + 1 + i] + moved[i][0]
        return held[k], x

    beta, _, sound = stepped(packed, [exchange.Channel(c, [f"_r{i}"]) for i, c in enumerate(tested)], [*features, target, *rebuilt], count, seed, len(tested), k + 1, design)
    return stat_rows(frame.sparkSession, tested, np.stack([beta[i, :, features.index(c) + 1] / scale[c] for i, c in enumerate(tested)]), sound)


def rebuilt_columns(frame: DataFrame, m: Moments, features: list[str], target: str, tested: list[str], confounders: list[str]) -> tuple[exchange.Packed, list[str], dict[str, float]]:
    """Packed scaled features, outcome, and of each tested feature its fit on the confounders and residual, in the feature's scale."""
    scale = {c: math.sqrt(m.block([c], [c])[0, 0]) for c in features}
    columns = scaled(m, features) | {target: F.col(target)}
    for i, c in enumerate(tested):
        hat = linear(*m.fit(c, confounders), confounders)
        columns |= {f"_h{i}": (hat - F.lit(m.mean[c])) / F.lit(scale[c]), f"_r{i}": residual(m, c, confounders) / F.lit(scale[c])}
    return exchange.pack(frame, m.n, columns), [f"_h{i}" for i in range(len(tested))], scale


def kennedy_joint(frame: DataFrame, m: Moments, features: list[str], target: str, confounders: list[str], count: int, seed: int) -> tuple[float, DataFrame]:
    """Observed fall of the deviance by the tested features, and (rep, improvement, sound) with rows of their residuals permuted."""
    tested = [x for x in features if x not in confounders]
    if not tested:
        raise ValueError("every feature is a confounder: nothing is left to test")
    base = -2 * fit(frame, m, target, confounders)["ll"]
    full = fit(frame, m, target, features)
    observed = base + 2 * full["ll"]
    if m.n <= FEW_ROWS:
        work = frame.select("rid", *[residual(m, c, confounders).alias(f"_r{i}") for i, c in enumerate(tested)])
        fixed = [*confounders, target]
        moved = resample.at_positions(resample.permuted(work, m.n, count, seed, "joint", [f"_r{i}" for i in range(len(tested))]), frame.select("rid", *fixed), m.n, fixed)
        for i, c in enumerate(tested):
            moved = moved.withColumn(c, linear(*m.fit(c, confounders), confounders) + F.col(f"_r{i}"))
        done = whole_replicates(moved, target, [*tested, *confounders])
        return float(observed), done.select("rep", (F.lit(base) - F.col("deviance")).alias("improvement"), "sound")
    packed, rebuilt, _ = rebuilt_columns(frame, m, features, target, tested, confounders)
    k = len(features)

    def design(i, reps, pos, moved, held):
        x = list(held[:k])
        for j, c in enumerate(tested):
            x[features.index(c)] = held[k + 1 + j] + moved[0][j]
        return held[k], x

    _, dev, sound = stepped(packed, [exchange.Channel("joint", [f"_r{i}" for i in range(len(tested))])], [*features, target, *rebuilt], count, seed, 1, k + 1, design)
    table = pa.table({"rep": np.arange(1, count + 1), "improvement": base - dev[0], "sound": sound[0]})
    return float(observed), frame.sparkSession.createDataFrame(table)
