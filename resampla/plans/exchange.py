"""Rows packed by range, and replicates that move values between ranges without a join.

A frame's rows 1..n are packed into ranges of ``per`` consecutive rows, a float matrix each (one shuffle of n rows).  In a
replicate every row's value goes to a permuted position.  The sending range computes the positions of its rows for a block of
replicates and sends each receiving range one binary array: the values in the order of their positions, nothing else.  The receiving
range runs the permutation backwards, so it knows which range each of its positions got its value from, and scatters the
arrays.  It has its own rows beside them, computes sums, and emits one state (replicates x sums) for the block; states
are added up a tree of ranges.  What a task holds is bounded by ``BLOCK_BYTES`` of moved values, whatever n and the number of replicates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.operators import resample

MOST, LEAST, BLOCK_BYTES, FAN = 1 << 18, 512, 16 << 20, 64


@dataclass
class Packed:
    """(range, data) of rows 1..n: ``columns`` x rows doubles of each range."""

    frame: DataFrame
    n: int
    per: int
    columns: list[str]

    @property
    def ranges(self) -> int:
        return max(1, -(-self.n // self.per))


def pack(frame: DataFrame, n: int, columns: dict[str, Column], per: int | None = None) -> Packed:
    """Ranges of the rows of ``frame``, which has ``rid``; about as many as the cluster has slots, between LEAST and MOST rows each."""
    spark = frame.sparkSession
    per = per or min(MOST, max(LEAST, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    names = list(columns)
    out = Packed(frame, n, per, names)
    rows = frame.select(F.floor((F.col("rid") - 1) / per).cast("int").alias("range"), F.col("rid").cast("long"), *[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())])

    def run(batches):
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held)
            order = np.argsort(t.column("rid").to_numpy())
            data = np.stack([t.column(f"_{i}").to_numpy()[order] for i in range(len(names))]) if names else np.zeros((0, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array([t.column("range")[0].as_py()], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["range", "data"])

    out.frame = rows.repartitionById(out.ranges, "range").mapInArrow(run, "range int, data binary")
    return out


@dataclass
class Channel:
    """One permutation a replicate, of the name's draws, that moves some columns together."""

    name: str
    columns: list[str]


def blocks(count: int, width: int) -> list[tuple[int, int]]:
    """First and last replicate (1-based, half open) of blocks of at most ``width``."""
    return [(lo, min(lo + width, count + 1)) for lo in range(1, count + 1, max(1, width))]


def few(x: np.ndarray, ranges: int) -> np.ndarray:
    """Numbers of ranges in 16 bits if they fit, of which a stable sort takes two passes instead of comparisons."""
    return x.astype(np.uint16) if ranges <= 1 << 16 else x


def split_by_range(pos: np.ndarray, per: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From positions (replicates x rows): an order of the flat values by (range, replicate, position), their counts by range and replicate, and where ranges end."""
    reps, rows = pos.shape
    inner = np.argsort(pos, axis=1)
    dest = (np.take_along_axis(pos, inner, 1) - 1) // per
    flat = (inner + np.arange(reps)[:, None] * rows).ravel()
    outer = np.argsort(few(dest.ravel(), ranges), kind="stable")
    counts = np.bincount((dest * reps + np.arange(reps)[:, None]).ravel(), minlength=ranges * reps).reshape(ranges, reps)
    return flat[outer], counts, np.cumsum(counts.sum(1))


def scattered(parts: list[tuple[np.ndarray, np.ndarray]], source: np.ndarray) -> np.ndarray:
    """(columns, replicates, rows): the arrays of the sending ranges, in their order, put at the positions that got their values from them (``source``: replicates x rows)."""
    reps, rows = source.shape
    label = np.concatenate([np.repeat(np.arange(reps), counts) for counts, _ in parts])
    values = np.concatenate([v for _, v in parts], axis=1)[:, np.argsort(label, kind="stable")].reshape(-1, reps, rows)
    out = np.empty_like(values)
    at = np.argsort(few(source, int(source.max(initial=0)) + 1), axis=1, kind="stable")
    for c in range(len(out)):
        np.put_along_axis(out[c], at, values[c], 1)
    return out


def exchanged(packed: Packed, channels: list[Channel], fixed: list[str], count: int, seed: int, sums: Callable, live: np.ndarray | None = None) -> DataFrame:
    """(first, state): for each block of replicates, from its first one on, the sums over all rows.

    ``sums(reps, pos, moved, held)`` gets the replicates' numbers, the positions of a range, for each channel its moved
    columns (columns x replicates x rows) and the range's own ``fixed`` columns, and returns replicates x sums.  Blocks
    without any replicate marked in ``live`` are left out.
    """
    n, per, ranges = packed.n, packed.per, packed.ranges
    at = {c: i for i, c in enumerate(packed.columns)}
    lanes = sum(len(c.columns) for c in channels)
    todo = [(lo, hi) for lo, hi in blocks(count, max(1, BLOCK_BYTES // (8 * per * max(1, lanes)))) if live is None or live[lo - 1 : hi - 1].any()]
    row = pa.schema([("dest", pa.int32()), ("block", pa.int32()), ("channel", pa.int32()), ("source", pa.int32()), ("counts", pa.binary()), ("data", pa.binary())])

    def send(batches):
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(raw.as_buffer(), np.float64).reshape(len(at), -1)
                rid = np.arange(r * per + 1, r * per + 1 + data.shape[1])
                for b, (lo, hi) in enumerate(todo):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([b""]), pa.array([data[[at[c] for c in fixed]].tobytes()])], schema=row)
                    for k, channel in enumerate(channels):
                        pos = resample.positions(rid, n, seed, channel.name, np.arange(lo, hi))
                        order, counts, ends = split_by_range(pos, per, ranges)
                        values = np.stack([np.broadcast_to(data[at[c]], pos.shape).ravel()[order] for c in channel.columns])
                        met = np.flatnonzero(counts.sum(1))
                        starts = np.r_[0, ends[:-1]]
                        ints = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), len(met)))
                        yield pa.RecordBatch.from_arrays([ints(met), ints(b), ints(k), ints(r), pa.array([counts[d].astype(np.int32).tobytes() for d in met]), pa.array([np.ascontiguousarray(values[:, starts[d] : ends[d]]).tobytes() for d in met])], schema=row)

    def one(dest, b, rows):
        lo, hi = todo[b]
        here = min(per, n - dest * per)
        pos = np.arange(dest * per + 1, dest * per + 1 + here)
        held = np.zeros((len(fixed), here))
        parts: list[list] = [[] for _ in channels]
        for k, counts, data in rows:
            if k < 0:
                held = np.frombuffer(data, np.float64).reshape(len(fixed), -1)
            else:
                parts[k].append((np.frombuffer(counts, np.int32), np.frombuffer(data, np.float64).reshape(len(channels[k].columns), -1)))
        moved = []
        for channel, p in zip(channels, parts):
            source = (resample.origins(pos, n, seed, channel.name, np.arange(lo, hi)) - 1) // per
            moved.append(scattered(p, source))
        state = np.ascontiguousarray(sums(np.arange(lo, hi), pos, moved, held), np.float64)
        return pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([dest], pa.int32()), pa.array([state.tobytes()])], names=["first", "part", "state"])

    def receive(batches):
        key, rows = None, []
        for batch in batches:
            for d, b, k, _, counts, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (d, b) != key:
                    if rows:
                        yield one(*key, rows)
                    key, rows = (d, b), []
                rows.append((k, counts, data))
        if rows:
            yield one(*key, rows)

    sent = packed.frame.mapInArrow(send, "dest int, block int, channel int, source int, counts binary, data binary")
    tasks = int(min(ranges * len(todo), max(int(packed.frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), packed.frame.sparkSession.sparkContext.defaultParallelism, ranges)))
    met = sent.withColumn("to", ((F.col("dest") * len(todo) + F.col("block")) % tasks).cast("int")).repartitionById(tasks, "to").drop("to")
    states = met.sortWithinPartitions("dest", "block", "channel", "source").mapInArrow(receive, "first long, part int, state binary")
    return added(states, ranges)


def added(states: DataFrame, parts: int, key: str = "first") -> DataFrame:
    """(key, state): equally long arrays of doubles summed by key, up a tree of FAN parts a node."""

    def run(k, table):
        total = 0.0
        for raw in table.column("state"):
            total = total + np.frombuffer(raw.as_buffer(), np.float64)
        return pa.table({key: [k[0].as_py()], "part": pa.array([k[1].as_py()], pa.int32()), "state": [total.tobytes()]})

    while parts > 1:
        parts = -(-parts // FAN)
        states = states.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(key, "part").applyInArrow(run, f"{key} long, part int, state binary")
    return states.select(key, "state")


def summed(packed: Packed, sums: Callable) -> np.ndarray:
    """``sums`` of the matrix of each range, added up: one state of a bounded size reaches the driver."""

    def run(batches):
        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1)):
                state = np.ascontiguousarray(sums(np.frombuffer(raw.as_buffer(), np.float64).reshape(len(names), -1)), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([r], pa.int32()), pa.array([state.tobytes()])], names=["first", "part", "state"])

    names = packed.columns
    states = packed.frame.mapInArrow(run, "first long, part int, state binary")
    states = added(states, packed.ranges) if packed.ranges > FAN else states  # up to FAN states are added here
    return sum(np.frombuffer(x["state"], np.float64) for x in states.select("state").collect())


def replicate_rows(states: DataFrame, width: int, finish: Callable, schema: str) -> DataFrame:
    """Rows of each replicate from the summed states: ``finish(reps, sums)`` gives columns of ``schema``."""

    def run(batches):
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1)):
                sums = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, width)
                yield from finish(np.arange(first, first + len(sums)), sums)

    return states.mapInArrow(run, schema)
