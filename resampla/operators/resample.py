"""Resampling keyed by hashes: the same draws for any partitioning, and in any engine that has md5."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-9
BROADCAST_ROWS = 200_000


def replicates(spark: SparkSession, count: int) -> DataFrame:
    if count < 1:
        raise ValueError("at least one replicate is needed")
    return spark.range(1, count + 1).withColumnRenamed("id", "rep")


def key(seed: int, name: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[p.cast("string") for p in parts]))


def number(digest: Column) -> Column:
    """60 bits of a digest as a whole number."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")


# ---------------------------------------------------------------- permutations without a sort

PRIME, ROUNDS = 2**31 - 1, 24


@lru_cache(4096)
def constants(seed: int, name: str, rep: int) -> tuple[tuple[int, int, int], ...]:
    """(shift, factor, addend) of each round of a replicate, from digests."""
    out = []
    for i in range(ROUNDS):
        d = hashlib.md5(f"{seed}:{name}:{rep}:{i}".encode()).hexdigest()
        out.append((int(d[:15], 16), int(d[15:23], 16) % (PRIME - 1) + 1, int(d[23:31], 16) % PRIME))
    return tuple(out)


def under_prime(x):
    """Remainders by PRIME of whole numbers from 0 on; a division by a constant is far cheaper than ``%``."""
    return x - x // PRIME * PRIME


CACHED = 1 << 16  # numbers worked on at a time


def sent(x: np.ndarray, n: int, seed: int, name: str, reps: np.ndarray, back: bool) -> np.ndarray:
    """(replicates, len(x)): each replicate's rounds, forwards or backwards, on places counted from 0."""
    out = np.empty((len(reps), len(x)), np.int64)
    width = max(1, CACHED // max(1, len(x)))
    for lo in range(0, len(reps), width):
        k = np.array([constants(seed, name, int(r)) for r in reps[lo : lo + width]], dtype=np.int64).transpose(1, 2, 0)[..., None]  # rounds, numbers, replicates, 1
        here = np.broadcast_to(x, (k.shape[2], len(x)))
        for shift, factor, addend in k[::-1] if back else k:
            y = (shift % n + n) - here
            y -= n * (y >= n)
            high = np.maximum(here, y)
            h = under_prime(factor * (high if n <= PRIME else under_prime(high)) + addend)
            here = np.where(under_prime(h * h + addend) & 1, y, here)
        out[lo : lo + width] = here
    return out


def positions(rid: np.ndarray, n: int, seed: int, name: str, rep) -> np.ndarray:
    """Where a replicate's permutation of 1..n sends each of the given rows; a row of places each for several replicates.

    A swap-or-not shuffle: in each round the row and its mirror image about a drawn point swap places or don't, by a
    drawn function of the two, so every round is a bijection of any 1..n, and rows need neither a sort nor each other.
    """
    out = sent(rid.astype(np.int64) - 1, n, seed, name, np.atleast_1d(rep), False) + 1
    return out if np.ndim(rep) else out[0]


def origins(pos: np.ndarray, n: int, seed: int, name: str, rep) -> np.ndarray:
    """The rows that a replicate's permutation sends to the given positions: every round undoes itself, so rounds run backwards."""
    out = sent(pos.astype(np.int64) - 1, n, seed, name, np.atleast_1d(rep), True) + 1
    return out if np.ndim(rep) else out[0]


def uniforms(pos: np.ndarray, seed: int, name: str, rep: int) -> np.ndarray:
    """A draw from [0, 1) for each position of a replicate."""
    (_, a, b), (_, c, d) = constants(seed, name, rep)[:2]
    h = under_prime(a * under_prime(pos.astype(np.int64)) + b)
    return under_prime(c * under_prime(h * h + d) + b) / PRIME


def permuted(frame: DataFrame, n: int, count: int, seed: int, name: str, columns: list[str], draws: str | None = None) -> DataFrame:
    """(rep, rid, pos, columns): in each replicate the rows' values moved to permuted positions 1..n; with ``draws``, a draw for each position as ``u``.

    Every row computes its positions where it is: no shuffle and no sort.
    """
    schema = "rep long, rid long, pos long, " + ", ".join([f"`{c}` double" for c in columns] + (["u double"] if draws else []))

    spark = frame.sparkSession
    parts = min(count, 2 * spark.sparkContext.defaultParallelism) if n <= BROADCAST_ROWS else 1  # few rows go to tasks that share out the replicates

    def run(batches):
        for b in batches:
            rid = b.column(1).to_numpy()
            for rep in range(b.column(0)[0].as_py() + 1 if len(rid) else count + 1, count + 1, parts):
                pos = positions(rid, n, seed, name, rep)
                more = [pa.array(uniforms(pos, seed, draws, rep))] if draws else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), rep)), b.column(1), pa.array(pos), *b.columns[2:], *more], names=["rep", "rid", "pos", *columns, *(["u"] if draws else [])])

    rows = frame.select(F.col("rid").cast("long"), *[F.col(c).cast("double") for c in columns])
    rows = rows.select(F.lit(0).cast("long").alias("_part"), "*") if parts == 1 else spark.range(0, parts, 1, parts).toDF("_part").crossJoin(F.broadcast(rows))
    return rows.mapInArrow(run, schema)


def at_positions(moved: DataFrame, frame: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Permuted values beside the values that rows 1..n hold; the frame is broadcast only while it is small."""
    fixed = frame.select(F.col("rid").alias("pos"), *columns)
    return moved.join(F.broadcast(fixed) if n <= BROADCAST_ROWS else fixed, "pos")


def bernoulli(p: Column, u: Column) -> Column:
    """1.0 where the draw is under p, which is kept between 0.001 and 0.999."""
    return (u < F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))).cast("double")


def exceeds(stat: Column, observed: Column) -> Column:
    """At least as far from zero as observed; ties up to rounding count."""
    return F.abs(stat) >= F.abs(observed) * (1 - TOLERANCE)


def p_value(exceed: Column, count: Column) -> Column:
    """Phipson and Smyth: the observed statistic is a member of the reference set."""
    return (exceed + 1) / (count + 1)
