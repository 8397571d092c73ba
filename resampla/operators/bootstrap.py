"""Bootstrap by multinomial counts: each row learns how often each replicate drew it, without a join.

n draws with replacement from rows 1..n are counts, and counts split down a tree of row ranges: of the m draws of a range, its first
half gets Binomial(m, its share of the rows).  Ranges of up to LEAF rows, and those LEVELS deep, deal their draws out singly.  Every number comes from a hash of
(seed, replicate, node of the tree), so any task can walk from the root to its own rows, and SQL can repeat the draws.
Binomials are exact up to rounding: transformed rejection for a mean of 10 or more, single trials below.

A replicate's moments are sums weighted by these counts: a matrix product in each range, added up a tree of ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.operators.resample import PRIME, constants, under_prime
from resampla.plans import exchange
from resampla.plans.frame import Moments

LEAF, LEVELS, MIXES, ATTEMPTS, STATE_BYTES, CHUNK_BYTES = 128, 12, 6, 1000, 16 << 20, 16 << 20
DEALT = 1 << 13  # draws that are dealt out at once

# ---------------------------------------------------------------- numbers


def streams(seed: int, reps) -> np.ndarray:
    """(replicates, 2, MIXES): factors and addends of each replicate's hash."""
    return np.array([[[k[at] for k in constants(seed, "boot", int(r))[:MIXES]] for at in (1, 2)] for r in reps], np.int64).reshape(-1, 2, MIXES)


def noise(s: np.ndarray, x, y):
    """Whole numbers under PRIME from node ``x`` and serial ``y``: squares, so that successive serials are no short polynomial."""
    a, b = s[:, 0].T, s[:, 1].T
    h = under_prime(a[0] * (x % PRIME) + b[0])
    h = under_prime(a[1] * under_prime(h * h + y) + b[1])
    for i in range(2, MIXES):
        h = under_prime(a[i] * under_prime(h * h + b[i]) + b[i - 1])
    return h


def uniform(s: np.ndarray, x, y):
    """Draws from [0, 1) with 53 bits."""
    return (noise(s, x, 2 * y) + noise(s, x, 2 * y + 1) / PRIME) / PRIME


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from 10 up; arguments below are shifted there."""
    x = np.asarray(x, float)
    low = x < 10
    z = np.where(low, x + 10, x)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    if low.any():
        out = out - np.where(low, np.log(np.where(low, x, 1.0)[..., None] + np.arange(10)).sum(-1), 0.0)
    return out


def binomial(s: np.ndarray, node: int, m: np.ndarray, share: float) -> np.ndarray:
    """Binomial(m, share) of each replicate at a node."""
    p = min(share, 1 - share)
    out = np.zeros(len(m), np.int64)
    few = np.flatnonzero((m * p < 10) & (m > 0))
    for i in few:
        out[i] = (uniform(s[i : i + 1], node, np.arange(m[i])) < p).sum()
    open_ = np.flatnonzero(m * p >= 10)
    for t in range(ATTEMPTS):
        if not len(open_):
            break
        n = m[open_].astype(float)
        spread = np.sqrt(n * p * (1 - p))
        b = 1.15 + 2.53 * spread
        a, c, v_r = -0.0873 + 0.0248 * b + 0.01 * p, n * p + 0.5, 0.92 - 4.2 / b
        alpha, mode = (2.83 + 5.1 / b) * spread, np.floor((n + 1) * p)
        u, v = uniform(s[open_], node, 2 * t) - 0.5, uniform(s[open_], node, 2 * t + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a / us + b) * u + c)
        inside = (k >= 0) & (k <= n)
        k_ = np.clip(k, 0, n)
        far = np.log(v * alpha / (a / (us * us) + b)) <= log_gamma(mode + 1) + log_gamma(n - mode + 1) - log_gamma(k_ + 1) - log_gamma(n - k_ + 1) + (k_ - mode) * math.log(p / (1 - p))
        done = inside & (((us >= 0.07) & (v <= v_r)) | far)
        out[open_[done]] = k[done].astype(np.int64)
        open_ = open_[~done]
    else:
        raise RuntimeError("a binomial draw was refused too often")
    return out if share <= 0.5 else m - out


def leaves(s: np.ndarray, n: int, lo: int, hi: int):
    """(node, first row, rows, draws of each replicate) of the leaves that hold rows lo..hi-1, counted from 0."""
    stack = [(1, 0, n, np.full(len(s), n, np.int64))]
    while stack:
        node, first, size, m = stack.pop()
        if first >= hi or first + size <= lo:
            continue
        if size <= LEAF or node >> LEVELS:
            yield node, first, size, m
            continue
        half = size // 2
        left = binomial(s, node, m, half / size)
        stack += [(2 * node + 1, first + half, size - half, m - left), (2 * node, first, half, left)]


def counts(s: np.ndarray, n: int, lo: int, hi: int):
    """(first row, replicates x rows counts) of consecutive pieces that cover rows lo..hi-1."""
    for node, first, size, m in leaves(s, n, lo, hi):
        a, b = max(lo, first), min(hi, first + size)
        drawn = np.zeros((len(s), b - a), np.int32)
        before, total = np.cumsum(m) - m, int(m.sum())
        for at in range(0, total, DEALT):
            draw = np.arange(at, min(at + DEALT, total))
            rep = np.searchsorted(before, draw, "right") - 1
            row = first + (uniform(s[rep], node, draw - before[rep]) * size).astype(np.int64)
            here = (row >= a) & (row < b)
            np.add.at(drawn.reshape(-1), (rep * (b - a) + row - a)[here], 1)
        yield a, drawn


# ---------------------------------------------------------------- tables


def drawn(frame: DataFrame, n: int, count: int, seed: int) -> DataFrame:
    """(rep, rid, times) of the rows that each replicate drew; a row's counts are made where it lies."""
    spark = frame.sparkSession
    per = min(exchange.MOST, max(exchange.LEAST, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    ranges, todo = max(1, -(-n // per)), exchange.blocks(count, 64)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r, b = i % ranges, i // ranges
                reps = np.arange(*todo[b])
                for first, w in counts(streams(seed, reps), n, r * per, min(n, (r + 1) * per)):
                    at, row = np.nonzero(w)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(first + 1 + row), pa.array(w[at, row].astype(np.int64))], names=["rep", "rid", "times"])

    return spark.range(0, ranges * len(todo), 1, ranges * len(todo)).mapInArrow(run, "rep long, rid long, times long") if n else spark.createDataFrame([], "rep long, rid long, times long")


def moment_states(frame: DataFrame, m: Moments, columns: list[str], count: int, seed: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(first, state): for blocks of replicates, weighted sums of the centred columns and of their products (i <= j), and the blocks."""
    n, p = m.n, len(columns)
    packed = exchange.pack(frame, n, {c: F.col(c) - F.lit(m.mean[c]) for c in columns})
    per, ranges, width = packed.per, packed.ranges, p + p * (p + 1) // 2
    slots = 2 * frame.sparkSession.sparkContext.defaultParallelism
    todo = exchange.blocks(count, min(max(1, STATE_BYTES // (8 * width)), max(16, -(-count * ranges // slots))))
    i, j = np.triu_indices(p)
    chunk = max(LEAF, CHUNK_BYTES // (8 * width))

    def run(batches):
        for batch in batches:
            for r, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(raw.as_buffer(), np.float64).reshape(p, -1)
                s = streams(seed, range(*todo[b]))
                state, held, at, begun = np.zeros((len(s), width)), [], r * per, r * per
                end = r * per + x.shape[1]
                for first, w in counts(s, n, r * per, end):
                    held.append(w)
                    at = first + w.shape[1]
                    if at - begun >= chunk or at == end:
                        y = x[:, begun - r * per : at - r * per]
                        state += np.concatenate(held, 1).astype(float) @ np.concatenate([y, y[i] * y[j]]).T
                        held, begun = [], at
                yield pa.RecordBatch.from_arrays([pa.array([todo[b][0]]), pa.array([r], pa.int32()), pa.array([state.tobytes()])], names=["first", "part", "state"])

    each = packed.frame.select("range", F.explode(F.sequence(F.lit(0), F.lit(len(todo) - 1))).alias("block"), "data")
    tasks = min(ranges * len(todo), max(slots, ranges))
    dealt = each.withColumn("to", ((F.col("range") * len(todo) + F.col("block")) % tasks).cast("int")).repartitionById(tasks, "to").drop("to")
    return exchange.added(dealt.mapInArrow(run, "first long, part int, state binary"), ranges), todo


def covariances(state: np.ndarray, n: int, p: int) -> np.ndarray:
    """(replicates, p, p): covariances (divided by n - 1) from summed states."""
    out = np.zeros((len(state), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = out[:, j, i] = (state[:, p:] - state[:, i] * state[:, j] / n) / (n - 1)
    return out


def indirect_effects(frame: DataFrame, m: Moments, pairs: list[tuple[str, str]], target: str, count: int, seed: int) -> DataFrame:
    """(pair, rep, value): product of paths a and b of each pair (predictor, mediator) in every replicate, null where undefined."""
    columns = sorted({c for p in pairs for c in p} | {target})
    at = {c: k for k, c in enumerate(columns)}
    xs, zs, y = np.array([at[x] for x, _ in pairs]), np.array([at[z] for _, z in pairs]), at[target]
    states, _ = moment_states(frame, m, columns, count, seed)
    p = len(columns)

    def finish(reps, sums):
        c = covariances(sums, m.n, p)
        for r, one in zip(reps, c):
            _, a, b, _ = path_values(one, xs, zs, y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(np.full(len(pairs), r)), pa.array(a * b, from_pandas=True)], names=["pair", "rep", "value"])

    return exchange.replicate_rows(states, p + p * (p + 1) // 2, finish, "pair long, rep long, value double")


def path_values(c: np.ndarray, xs: np.ndarray, zs: np.ndarray, y: int) -> tuple[np.ndarray, ...]:
    """Total effect, a, b and direct effect of many pairs from one covariance matrix; NaN where undefined."""
    xx, zz, xz, xy, zy = c[xs, xs], c[zs, zs], c[xs, zs], c[xs, y], c[zs, y]
    low = xx * zz - xz**2
    over = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)
    return over(xy, xx), over(xz, xx), over(zy * xx - xy * xz, low), over(xy * zz - zy * xz, low)
