"""Analysis frames: validation, dense row numbers, outcome detection, and moments in one pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANK, SAMPLED = 1_000_000, 100


class CollinearFeatureError(ValueError):
    """A feature is constant, or a linear combination of the others."""


@dataclass
class Moments:
    """Count, means and centred second moments (divided by n) of some columns; of nearly dependent ones also a triangular factor."""

    names: list[str]
    n: int
    mean: dict[str, float]
    cov: np.ndarray
    factor: np.ndarray | None = None  # of the centred columns in units of their deviations

    def triangle(self, columns: list[str]) -> np.ndarray:
        """T with T'T the sums of products of the centred columns in units of their deviations."""
        if self.factor is not None:
            return np.linalg.qr(self.factor[:, [self.names.index(c) for c in columns]], "r")
        a = self.block(columns, columns)
        scale = np.sqrt(np.diag(a))
        return math.sqrt(self.n) * np.linalg.cholesky(a / np.outer(scale, scale)).T

    def inverse(self, on: list[str]) -> np.ndarray:
        """Inverse of the sums of products of the centred columns."""
        scale = np.sqrt(np.diag(self.block(on, on)))
        up = np.linalg.inv(self.triangle(on))
        return up @ up.T / np.outer(scale, scale)

    def exact(self, target: str, on: list[str]) -> tuple[np.ndarray, float]:
        """Slopes and residual sum of squares by the factor."""
        a, y = self.factor[:, [self.names.index(c) for c in on]], self.factor[:, self.names.index(target)]
        size = np.linalg.svd(a, compute_uv=False)
        if size[-1] < 1e-12 * size[0]:
            raise CollinearFeatureError(f"linearly dependent: {on}")
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        unit = np.sqrt(np.diag(self.block([*on, target], [*on, target])))
        return beta * unit[-1] / unit[:-1], float(((y - a @ beta) ** 2).sum() * unit[-1] ** 2)

    def block(self, a: list[str], b: list[str]) -> np.ndarray:
        at = {c: i for i, c in enumerate(self.names)}
        return self.cov[np.ix_([at[c] for c in a], [at[c] for c in b])]

    def fit(self, target: str, on: list[str]) -> tuple[float, np.ndarray]:
        """Intercept and slopes of least squares of one column on others."""
        if not on:
            return self.mean[target], np.zeros(0)
        a = self.block(on, on)
        scale = np.sqrt(np.diag(a))
        if (scale == 0).any():
            raise CollinearFeatureError(f"constant: {[c for c, s in zip(on, scale) if s == 0]}")
        if self.factor is not None:
            beta, _ = self.exact(target, on)
            return self.mean[target] - float(beta @ [self.mean[c] for c in on]), beta
        r = a / np.outer(scale, scale)
        if np.linalg.eigvalsh(r)[0] < 1e-10:
            raise CollinearFeatureError(f"linearly dependent: {on}")
        beta = np.linalg.solve(r, self.block(on, [target])[:, 0] / scale) / scale
        return self.mean[target] - float(beta @ [self.mean[c] for c in on]), beta

    def rss(self, target: str, on: list[str]) -> float:
        if self.factor is not None and on:
            return self.exact(target, on)[1]
        _, beta = self.fit(target, on)
        return float(self.n * (self.block([target], [target])[0, 0] - (beta @ self.block(on, [target])[:, 0] if on else 0.0)))


WIDE, BLOCK, ROWS, PARTS = 24, 256, 2048, 64


def block_sums(batches, p: int):
    """Each task's count, means and centred products as blocks: (first row of the block, first column, count, means of both, products)."""
    n, mean, products = 0, np.zeros(p), {(i, j): 0.0 for i in range(0, p, BLOCK) for j in range(i, p, BLOCK)}
    for b in batches:
        for lo in range(0, len(b), ROWS):
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(lo, ROWS).columns], axis=1)
            k, here = len(x), x.mean(0)
            x = x - here
            gap, both = here - mean, n * k / (n + k)
            for i, j in products:
                products[i, j] = products[i, j] + x[:, i : i + BLOCK].T @ x[:, j : j + BLOCK] + both * np.outer(gap[i : i + BLOCK], gap[j : j + BLOCK])
            mean, n = mean + gap * k / (n + k), n + k
    if n:
        part = TaskContext.get().partitionId() % PARTS
        for (i, j), s in products.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([part]), pa.array([n]), pa.array([mean[i : i + BLOCK].tobytes()]), pa.array([mean[j : j + BLOCK].tobytes()]), pa.array([np.ascontiguousarray(s).tobytes()])], names=["i", "j", "part", "n", "mean_i", "mean_j", "s"])


def merge_blocks(key, table):
    """The blocks of one place from several tasks as one."""
    n, s, mi, mj = 0, 0.0, 0.0, 0.0
    for k, a, b, raw in zip(*(table.column(c).to_pylist() for c in ("n", "mean_i", "mean_j", "s"))):
        a, b = np.frombuffer(a), np.frombuffer(b)
        s = s + np.frombuffer(raw).reshape(len(a), len(b)) + n * k / (n + k) * np.outer(a - mi, b - mj)
        mi, mj, n = mi + (a - mi) * k / (n + k), mj + (b - mj) * k / (n + k), n + k
    return pa.table({"i": [key[0].as_py()], "j": [key[1].as_py()], "part": [key[2].as_py() if len(key) > 2 else 0], "n": [n], "mean_i": [mi.tobytes()], "mean_j": [mj.tobytes()], "s": [s.tobytes()]})


def wide_moments(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of many columns: blocks of the matrix of products summed in each task, merged by block up a tree; p x p numbers reach the driver."""
    p, kind = len(columns), "i long, j long, part long, n long, mean_i binary, mean_j binary, s binary"
    rows = df.select(*[F.col(c).cast("double") for c in columns])
    parts = rows.mapInArrow(lambda batches: block_sums(batches, p), kind)
    near = parts.groupBy("i", "j", "part").applyInArrow(merge_blocks, kind)
    mean, cov, n = {}, np.zeros((p, p)), 0
    for r in near.groupBy("i", "j").applyInArrow(merge_blocks, kind).collect():
        n, i, j = r["n"], r["i"], r["j"]
        a, b = np.frombuffer(r["mean_i"]), np.frombuffer(r["mean_j"])
        cov[i : i + len(a), j : j + len(b)] = np.frombuffer(r["s"]).reshape(len(a), len(b)) / n
        cov[j : j + len(b), i : i + len(a)] = cov[i : i + len(a), j : j + len(b)].T
        mean |= {columns[i + k]: float(v) for k, v in enumerate(a)}
    return Moments(list(columns), n, mean or dict.fromkeys(columns), cov)


NEAR = 1e-6  # least eigenvalue of correlations under which products of columns say too little of them


def tall_factor(df: DataFrame, m: Moments) -> np.ndarray:
    """Triangular factor of the centred columns in units of their deviations: each task's rows, merged up a tree."""
    scale = np.sqrt(np.diag(m.cov))
    mean, scale = np.array([m.mean[c] for c in m.names]), np.where(scale > 0, scale, 1.0)
    p = len(m.names)

    def triangle(parts):
        r = np.zeros((0, p))
        for x in parts:
            r = np.linalg.qr(np.concatenate([r, x]), "r")
        return r

    def rows(batches):
        r = triangle((np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(lo, ROWS).columns], axis=1) - mean) / scale for b in batches for lo in range(0, len(b), ROWS))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTS]), pa.array([r.tobytes()])], names=["part", "r"])

    def merge(key, table):
        r = triangle(np.frombuffer(raw).reshape(-1, p) for raw in table.column("r").to_pylist())
        return pa.table({"part": [key[0].as_py()], "r": [r.tobytes()]})

    near = df.select(*[F.col(c).cast("double") for c in m.names]).mapInArrow(rows, "part long, r binary").groupBy("part").applyInArrow(merge, "part long, r binary")
    return triangle(np.frombuffer(x["r"]).reshape(-1, p) for x in near.orderBy("part").collect())


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """One partial aggregation over all rows; numerically centred as it goes.

    Beyond WIDE columns the products are summed as blocks.  Columns that nearly depend on each other take a second pass, for their factor.
    """
    m = wide_moments(df, columns) if len(columns) > WIDE else plain_moments(df, columns)
    live = np.flatnonzero(np.diag(m.cov) > 0)
    scale = np.sqrt(np.diag(m.cov))[live]
    if len(live) > 1 and np.linalg.eigvalsh(m.cov[np.ix_(live, live)] / np.outer(scale, scale))[0] < NEAR:
        m.factor = tall_factor(df, m)
    return m


def plain_moments(df: DataFrame, columns: list[str]) -> Moments:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return Moments(list(columns), row["n"], {c: row[f"m{i}"] for i, c in enumerate(columns)}, cov)


def linear(intercept: float, beta, columns: list[str]) -> Column:
    out = F.lit(float(intercept))
    for b, c in zip(beta, columns):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def residual(m: Moments, target: str, on: list[str]) -> Column:
    return F.col(target) - linear(*m.fit(target, on), on)


def positions(df: DataFrame, by: list[str], order: list[Column], cut: Column, out: str) -> DataFrame:
    """Dense ranks 1, 2, ... within ``by``, in the order of ``order``; ``cut`` is a non-decreasing function of that order.

    Rows are numbered within the pieces that ``cut`` makes and shifted by the rows of earlier
    pieces, so one task never sorts more than a piece.
    """
    df = df.withColumn("_cut", cut)
    sizes = df.groupBy(*by, "_cut").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*by, "_cut", F.coalesce(before, F.lit(0)).alias("_shift"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(*order)))
    return ranked.join(shift, [*by, "_cut"]).withColumn(out, F.col("_rank") + F.col("_shift")).drop("_cut", "_rank", "_shift")


def prepare(df: DataFrame, id_col: str, features: list[str], target: str, na: str = "fail") -> DataFrame:
    """(rid, features..., target) in doubles; rid is dense in the order of the id.

    Nulls, NaN and infinite values are an error, or their rows are left out with ``na='drop'``.
    """
    unknown = [c for c in [id_col, *features, target] if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {unknown}")
    if target in features or len(set(features)) < len(features):
        raise ValueError("the target must not be a feature, and features must differ")
    out = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in [*features, target]])
    sound = F.col("_id").isNotNull()
    for c in [*features, target]:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    if na == "drop":
        out = out.where(sound)
    stats = out.agg(F.count("*").alias("n"), F.count_if(~sound).alias("bad"), F.count_if(F.col("_id").isNull()).alias("none")).first()
    if stats["bad"]:
        raise ValueError(f"{stats['bad']} rows have null, NaN or infinite values")
    pieces = -(-stats["n"] // ROWS_PER_RANK)
    cut = F.lit(0)
    if pieces > 1:
        every = max(1, stats["n"] // (SAMPLED * pieces))  # ids of any ordered type, about SAMPLED of them a piece
        seen = [r["_id"] for r in out.where(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).select("_id").distinct().orderBy("_id").collect()]
        for b in sorted({seen[i * len(seen) // pieces] for i in range(1, pieces)}) if seen else []:
            cut = cut + (F.col("_id") > F.lit(b)).cast("int")
    # rows that share an id are told apart by their values
    return positions(out, [], [F.col(c) for c in ["_id", *features, target]], cut, "rid").drop("_id")


def outcome_kind(df: DataFrame, target: str) -> str:
    """'logistic' if the target has exactly the two values 0 and 1, else 'linear'."""
    row = df.agg(F.min(target).alias("a"), F.max(target).alias("b"), F.bool_and(F.col(target).isin(0.0, 1.0)).alias("only")).first()
    return "logistic" if row["only"] and row["a"] == 0 and row["b"] == 1 else "linear"
