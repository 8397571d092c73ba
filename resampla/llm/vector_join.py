"""Exact cosine range self-join of vectors: pivots, triangle inequality, independent cells.

Vectors are normalised in double precision, so that cosine >= c means a chord of at most
r = sqrt(2 - 2c), which is a metric.  Pivots (vectors in the order of a hash) partition the vectors;
each belongs to the cell of its nearest pivot (lengths of under 256 vectors are one cell).  Their number, ``LEAST`` to the next power of four beyond n / ``CELL`` and
at most ``PIVOT_BYTES`` of vectors, is the one of least cost: on ``PROBES`` other vectors at most, the pairs
that the cells would compare, the distances to pivots, and ``MOVE`` times the copies that visit other cells.  It decides the
plan only; where vectors are spread so evenly that no pivot excludes anything, few cells cost least.  By the triangle inequality a vector can only link
into cell j if its distance to pivot j is at most the cell's radius plus r, and exceeds the
distance to its own pivot by at most 2 r; only then is it replicated there, and of two cells only to
the lower one, so every pair is met exactly once.  Cells join independently.

A cell's own vectors are cut into blocks and its visitors into chunks of bounded size, so a cell of
any size, a third of all rows included, is spread over many tasks of bounded memory.  Tasks compare
by matrix products: single precision decides all but the pairs within 1e-4 of the threshold, which
are computed in double.  They return link counts and a spanning forest of the links they found, not
the pairs, so a group of near copies costs rows in proportion to its size.

Null, empty, zero or non-finite vectors, or vectors with null components, link with nothing; only
vectors of the same length are compared.  Of repeated ids the normalised vector with the least bytes counts.  A null id is kept with no
links.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import connected_components, materialize, mix, partitions, trimmed

CELL, LEAST, BLOCK_BYTES, CHUNK_BYTES = 64, 4, 8 << 20, 16 << 20  # vectors of a cell at least, in the mean; cells at least; bytes of a block and of a chunk
PIVOT_BYTES, PROBES, MOVE = 16 << 20, 1000, 2000  # bytes of all pivots; vectors that the cost is measured on; comparisons that cost as much as moving a vector


def matrices(batch, pivots=1):
    """(length, ids, matrix of unit rows) for each vector length in the batch, from binary doubles; few rows at once where pivots are many."""
    step = max(1, (1 << 22) // pivots)
    ids, sizes = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 8
    raw = batch.column(1)
    for d in np.unique(sizes):
        every = np.flatnonzero(sizes == d)
        for at in np.split(every, range(step, len(every), step)):
            yield int(d), ids[at], np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), d)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that can link; v: the bytes of the normalised components in double precision."""
    v = F.col("v")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = plain.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            scale = np.maximum.reduceat(np.abs(flat), begin) if len(begin) else flat  # against overflow and underflow
            flat = flat / np.repeat(scale, size)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, begin)) if len(begin) else flat, size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[s : s + n].tobytes() for s, n in zip(begin, size)], pa.binary())], names=["id", "v"])

    return fine.mapInArrow(trimmed(run), "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))


def chords(x, pivots):
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def cells_of_least_cost(pivots, probes, n, r):
    """How many of the leading pivots to take for n vectors, by what the probes would compare and move."""
    dist = chords(probes, pivots)
    best, k = None, LEAST
    while k <= max(LEAST, len(pivots)):
        d = dist[:, :k]
        own, near = d.argmin(1), d.min(1)
        go = (d <= near.max() + r) & (d - near[:, None] <= 2 * r)
        share = np.bincount(own, minlength=d.shape[1]) / len(probes)
        cost = n * (go @ share).mean() / 2 + 3 * k + MOVE * (go.sum(1).mean() - 1) / 2  # a vector's
        if best is None or cost < best[0]:
            best = (cost, k)
        k *= 4
    return best[1]


def join_group(home_ids, home, ids, x, same, cos):
    """Link counts and forest edges between a block and a chunk; ``same``: within one block, each pair once."""
    h32, x32 = home.astype(np.float32), x.astype(np.float32)
    deg_h, deg_x = np.zeros(len(home_ids), np.int64), np.zeros(len(ids), np.int64)
    links = []
    for lo in range(0, len(home), 256):
        s = h32[lo : lo + 256] @ x32.T
        hit = s >= cos
        i, j = np.nonzero(np.abs(s - cos) < 1e-4)
        if len(i):
            hit[i, j] = np.einsum("ij,ij->i", home[lo + i], x[j]) >= cos
        if same:
            hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
        deg_h[lo : lo + 256] += hit.sum(1)
        if not same:
            deg_x += hit.sum(0)
        rows = np.flatnonzero(hit.any(1))
        if len(rows):
            cols = np.flatnonzero(hit.any(0))
            links.append((lo + rows, cols, hit[np.ix_(rows, cols)]))
    size = len(home_ids) + (0 if same else len(ids))
    label, shift = np.arange(size), 0 if same else len(home_ids)
    changed = bool(links)
    while changed:  # least label over the links until nothing changes
        before = label.copy()
        for rows, cols, m in links:
            low = np.where(m, label[shift + cols][None], size).min(1)
            label[rows] = np.minimum(label[rows], low)
            low = np.where(m, label[rows][:, None], size).min(0)
            label[shift + cols] = np.minimum(label[shift + cols], low)
        label = label[label]
        changed = (label != before).any()
    all_ids = home_ids if same else np.r_[home_ids, ids]
    deg = deg_h if same else np.r_[deg_h, deg_x]
    seen = np.flatnonzero(deg)
    return all_ids[seen], deg[seen], all_ids[label[seen]]


def cosine_components(vectors: DataFrame, cos: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    units = materialize(unit_vectors(vectors, id_col, vec_col), "units")
    r = float(np.sqrt(2 - 2 * cos))
    slack = 1e-6  # rounding of distances never excludes a pair
    width_of = units.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).count().collect()  # one row per length of vectors
    pivots: dict[int, np.ndarray] = {}
    for d, n in width_of:
        if n < LEAST * CELL:
            pivots[d] = np.zeros((1, d))  # one cell, around the origin
            continue
        wanted = LEAST
        while wanted * CELL < n and 4 * wanted * 8 * d * len(width_of) <= PIVOT_BYTES:
            wanted *= 4
        picked = units.where(F.octet_length("v") == 8 * d).orderBy(F.xxhash64("id"), "id").limit(wanted + PROBES).collect()
        some = np.stack([np.frombuffer(x["v"], np.float64) for x in picked])
        wanted = min(wanted, len(some) // 2)
        pivots[d] = some[: cells_of_least_cost(some[:wanted], some[wanted:], n, r)]
    first = {d: sum(len(p) for e, p in sorted(pivots.items()) if e < d) for d in pivots}  # cells are numbered over all lengths
    most = max((len(p) for p in pivots.values()), default=1)

    def near(d, x):
        return chords(x, pivots[d])

    def base(d):
        return first[d]

    def measure(batches):
        for batch in batches:
            for d, _, x in matrices(batch, most):
                dist = near(d, x)
                own = dist.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own + base(d)), pa.array(dist[np.arange(len(x)), own])], names=["cell", "far"])

    stats = units.mapInArrow(trimmed(measure), "cell long, far double").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    radius, count = {s["cell"]: s["r"] for s in stats}, {s["cell"]: s["n"] for s in stats}  # one row per pivot

    def visits(d, dist, own):
        """Boolean (vectors, cells of this length): other, lower cells that the vector must visit."""
        reach = np.array([radius.get(base(d) + j, -9.0) for j in range(dist.shape[1])])
        go = (dist <= reach + r + slack) & (dist - dist[np.arange(len(dist)), own][:, None] <= 2 * r + slack)
        return go & (np.arange(dist.shape[1])[None] < own[:, None])

    def tally(batches):
        for batch in batches:
            for d, _, x in matrices(batch, most):
                dist = near(d, x)
                n = visits(d, dist, dist.argmin(1)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + base(d)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    guests = {s["cell"]: s["n"] for s in units.mapInArrow(trimmed(tally), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    width = {c: 8 * next(d for d in pivots if first[d] <= c < first[d] + len(pivots[d])) for c in count}  # bytes of a cell's vectors
    blocks = {c: -(-n * width[c] // BLOCK_BYTES) for c, n in count.items()}
    chunks = {c: max(1, -(-(guests.get(c, 0) + n) * width[c] // CHUNK_BYTES)) for c, n in count.items()}

    def deal(batches):
        for batch in batches:
            out: dict[tuple, list] = {}
            for d, ids, x in matrices(batch, most):
                dist = near(d, x)
                own = dist.argmin(1)
                key = mix(ids.astype(np.uint64))
                go = visits(d, dist, own)
                for c in np.unique(own):
                    cell = int(c) + base(d)
                    block = (key % np.uint64(blocks[cell])).astype(np.int64)
                    mine = own == c
                    for s in range(blocks[cell]):
                        at = np.flatnonzero(mine & (block == s))
                        for g in range(chunks[cell]):  # the block itself stands in every one of its chunks
                            if len(at):
                                out.setdefault((cell, s, g, 0), []).append((ids[at], x[at]))
                for c in range(dist.shape[1]):
                    cell = c + base(d)
                    if cell not in blocks:
                        continue
                    block = (key % np.uint64(blocks[cell])).astype(np.int64)
                    part = ((key >> np.uint64(20)) % np.uint64(chunks[cell])).astype(np.int64)
                    mine, guest = own == c, go[:, c]
                    for s in range(blocks[cell]):
                        for g in range(chunks[cell]):
                            at = np.flatnonzero((part == g) & (guest | (mine & (block > s))))
                            if len(at):
                                out.setdefault((cell, s, g, 1), []).append((ids[at], x[at]))
            rows = [(*k, np.concatenate([i for i, _ in v]).tobytes(), np.concatenate([x for _, x in v]).tobytes()) for k, v in out.items()]
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cell", "block", "chunk", "role", "ids", "v"])

    def meet(batches):
        held, key = {0: [], 1: []}, None

        def flush():
            home, guest = held[0], held[1]
            if not home:
                return
            hi, hx = np.concatenate([i for i, _ in home]), np.concatenate([x for _, x in home])
            found = []
            if key[2] == 0:
                found.append(join_group(hi, hx, hi, hx, True, cos))
            if guest:
                found.append(join_group(hi, hx, np.concatenate([i for i, _ in guest]), np.concatenate([x for _, x in guest]), False, cos))
            for ids, deg, root in found:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(deg), pa.array(root)], names=["id", "n", "root"])

        for batch in batches:
            for cell, block, chunk, role, ids, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, block, chunk) != key:
                    if key is not None:
                        yield from flush()
                    key, held = (cell, block, chunk), {0: [], 1: []}
                ids = np.frombuffer(ids, np.int64)
                held[role].append((ids, np.frombuffer(v, np.float64).reshape(len(ids), -1)))
        if key is not None:
            yield from flush()

    keys = ["cell", "block", "chunk"]
    dealt = units.mapInArrow(trimmed(deal), "cell long, block long, chunk long, role int, ids binary, v binary")
    met = materialize(dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "role").mapInArrow(trimmed(meet), "id long, n long, root long"), "met")
    degree = met.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = connected_components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "cells")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    every = every.where("id is not null").distinct().unionByName(every.where("id is null"))
    out = every.join(degree, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)
