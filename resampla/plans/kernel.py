"""Replicate-parallel plan: small data go to every worker, replicates are spread over tasks.

Used only while the design matrix takes at most ``KERNEL_BYTES``; beyond that the row-parallel plan of
``operators.linear`` and ``operators.logistic`` does the same tests.  Both use the same draws, so the size of
the data doesn't change a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from resampla.operators import resample
from resampla.operators.logistic import newton

KERNEL_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20  # of the permuted values of a block of replicates


def fits(n: int, columns: int) -> bool:
    return n * (columns + 1) * 8 <= KERNEL_BYTES


def design(frame: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    if not fits(frame.count(), len(features)):
        raise ValueError("too many rows to send to every worker; use plan='rows'")
    rows = frame.orderBy("rid").select(*features, target).toPandas()
    return rows[features].to_numpy(float), rows[target].to_numpy(float)


def remainder(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    a = np.c_[np.ones(len(y)), z]
    return y - a @ np.linalg.lstsq(a, y, rcond=None)[0]


def null_distribution(frame: DataFrame, features: list[str], target: str, method: str, confounders: list[str], binary: bool, count: int, seed: int) -> DataFrame:
    """(rep, feature, stat, sound): refitted slopes, or the improvement under the name 'joint'."""
    x, y = design(frame, features, target)
    tested = [i for i, c in enumerate(features) if c not in confounders or method == "ter_braak"]
    z = x[:, [features.index(c) for c in confounders]]

    rid = np.arange(1, len(y) + 1)
    block = max(1, BLOCK_BYTES // (8 * max(1, len(y)) * max(1, len(tested))))

    def permutations(reps, name):
        """Row r of a replicate's permuted values is the row of the given ones that is sent there."""
        out = np.empty((len(reps), len(y)), np.int64)
        np.put_along_axis(out, resample.positions(rid, len(y), seed, name, np.asarray(reps)) - 1, np.broadcast_to(rid - 1, out.shape), 1)
        return out

    def braak(reps, j):
        rest = np.delete(x, j, 1)
        if not binary:
            e, own = remainder(y, rest), remainder(x[:, j], rest)
            return e[permutations(reps, features[j])] @ own / (own @ own), np.ones(len(reps), bool)
        b = newton(rest, y)[0] if rest.shape[1] else np.array([np.log(y.mean() / (1 - y.mean()))])
        p = 1 / (1 + np.exp(-(np.c_[np.ones(len(y)), rest] @ b)))
        out = []
        for r, perm in zip(reps, permutations(reps, features[j])):
            drawn = (resample.uniforms(rid, seed, f"{features[j]}:draw", int(r)) < np.clip(p + (y - p)[perm], 0.001, 0.999)).astype(float)
            b, _, ok = newton(x, drawn)
            out.append((b[j + 1], ok))
        return np.array([s for s, _ in out]), np.array([k for _, k in out])

    def kennedy(reps, j):
        r = remainder(x[:, j], z)
        hat = x[:, j] - r
        rest = np.delete(x, j, 1)
        moved = r[permutations(reps, features[j])]
        if not binary:
            e = remainder(y, rest)
            q = np.linalg.qr(np.c_[np.ones(len(y)), rest])[0]
            return moved @ e / ((r @ r) - ((moved @ q) ** 2).sum(1)), np.ones(len(reps), bool)
        out = []
        for one in moved:
            a = x.copy()
            a[:, j] = hat + one
            b, _, ok = newton(a, y)
            out.append((b[j + 1], ok))
        return np.array([s for s, _ in out]), np.array([k for _, k in out])

    def joint(reps):
        e = np.stack([remainder(x[:, j], z) for j in tested], 1)
        out = []
        if not binary:
            q, ry = np.linalg.qr(np.c_[np.ones(len(y)), z])[0], remainder(y, z)
            for perm in permutations(reps, "joint"):
                m = e[perm]
                a, c = q.T @ m, m.T @ ry
                out.append((c @ np.linalg.solve(e.T @ e - a.T @ a, c), True))
        else:
            hat = x[:, tested] - e
            base = newton(z, y)[1] if z.shape[1] else -2 * (y * np.log(y.mean()) + (1 - y) * np.log(1 - y.mean())).sum()
            for perm in permutations(reps, "joint"):
                _, d, ok = newton(np.c_[hat + e[perm], z], y)
                out.append((base - d, ok))
        return np.array([s for s, _ in out]), np.array([k for _, k in out])

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), block):
                reps = b["id"].to_numpy()[lo : lo + block]
                work = [("joint", *joint(reps))] if method == "kennedy_joint" else [(features[j], *(braak if method == "ter_braak" else kennedy)(reps, j)) for j in tested]
                for name, stat, ok in work:
                    yield pd.DataFrame({"rep": reps, "feature": name, "stat": stat, "sound": ok})

    spark = frame.sparkSession
    parts = min(count, max(spark.sparkContext.defaultParallelism * 2, 1))
    return spark.range(1, count + 1, 1, parts).mapInPandas(run, "rep long, feature string, stat double, sound boolean")
