"""Jaccard self-join of documents on word shingles, by a universe partition and the pigeonhole principle.

A document is the set of its distinct k-word shingles (fewer words: the whole sequence is the one
shingle; none: the empty set, which links with nothing).  Two sets link if their Jaccard similarity
is ``threshold`` or more.  Equal sets are one node throughout, so copies cost nothing more.

*Candidates.*  Sizes fall into bands whose bounds grow by 1/threshold, so that linked sets lie in the
same or in neighbouring bands.  Up to size ``hi``, linked sets differ in at most
``H = (1 - t) / (1 + t) * 2 hi`` shingles.  A band hashes shingles into segments; ``n0`` of them are
indexed as they are (they match if none of their shingles differs) and ``n1`` with all their
one-deletion neighbours (they match if at most one differs).  ``n0 + 2 n1 > H`` guarantees that linked
sets share a signature; among such allocations the one of least cost is taken (signatures
written, and expected false matches, which grow with the corpus).  Where segments are small there are more of them than needed, and each set
leaves out its smallest, which say least.  A node signs in its own band and the next one.

*Filter.*  Nodes that share a signature are compared by one byte hashes of ``F`` finer segments: more
differing bytes than the pair may have differing shingles exclude a link for certain.

*Verification.*  Passing pairs are verified on the whole sets in integers.  The first round takes for
each node and group the most alike partner; components follow; the second round takes every
remaining pair between different components, so no link between components is lost, while groups
that are already connected are not expanded into pairs.

Groups larger than ``BLOCK`` are split into pairs of blocks, so no task holds a whole group.  Null and
empty texts are in no group.  Rows that share an id are each a document by their own text, and so are rows without
one; their component is the smallest id that they reach, null if there is none.  Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import LOWER, U64, connected_components, discard, materialize, mix, partitions, shingles, slices, text_buffers, trimmed, word_hashes

BLOCK, BLOCK_BYTES, FIRST, RARITY = 2048, 8 << 20, 1, 0.05
BANDS = U64(0xFFF)
SIGN_BYTES = 1 << 20


def shingle_sets(data, offsets, k):
    """Sorted distinct shingles of all documents, their documents, and each document's first (with the total last)."""
    low = LOWER[data]
    _, _, docs, h = word_hashes(low, offsets)
    g, d, _ = shingles(h, docs, k)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.zeros(0, bool)
    g, d = g[new], d[new]
    return g, d, np.searchsorted(d, np.arange(len(offsets)))


def node_ids(g, first):
    """An even 64-bit identity of each set; 0 for the empty set."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    if len(g):
        full = np.flatnonzero(size)
        out[full] = mix(np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), first[:-1][full]) + size[full].astype(np.uint64)) & ~U64(1)
    return out


@lru_cache(None)
def band(i: int, num: int) -> tuple[int, int]:
    """Least and greatest size of band i for the threshold num / 100."""
    lo = 1 if i == 0 else band(i - 1, num)[1] + 1
    return lo, max(lo, lo * 100 // num)  # two linked sizes are never further apart than one band


def band_of(sizes: np.ndarray, num: int) -> np.ndarray:
    tops, i = [], 0
    while not tops or tops[-1] < (sizes.max() if len(sizes) else 0):
        tops.append(band(i, num)[1])
        i += 1
    return np.searchsorted(tops, sizes)


@lru_cache(None)
def allocation(i: int, num: int, nodes: int) -> tuple[int, int]:
    """(n0, n1) of band i in a corpus of ``nodes`` sets: plain segments, and segments with one-deletion neighbours.

    The cost of a signature is itself and the sets that match it by chance, ``RARITY`` of all for each shingle that it
    holds.  So deletions take over where segments hold few shingles, and the more sets there are the sooner.
    """
    hi = band(i, num)[1]
    most = 2 * hi * (100 - num) // (100 + num)
    best = None
    for n1 in range(most // 2 + 2):
        n0 = max(0, most + 1 - 2 * n1)
        m = n0 + n1
        if not m:
            continue
        size = hi / m
        cost = n0 * (1 + nodes * RARITY**size) + n1 * (1 + size) * (1 + nodes * RARITY ** max(size - 1, 0))
        if best is None or cost < best[0]:
            best = (cost, n0, n1)
    n0, n1 = best[1:]
    if not n1 and hi < 6 * n0:  # small segments: a quarter more of them, of which each set leaves out the smallest
        n0 += -(-n0 // 4)
    return n0, n1


@lru_cache(None)
def fine_segments(i: int, num: int) -> int:
    """Finer segments of the filter in band i."""
    most, fine = 2 * band(i, num)[1] * (100 - num) // (100 + num), 8
    while fine < 4 * most:
        fine *= 2
    return fine


def seed(b: int) -> np.uint64:
    """A constant of band b, so that bands cut the universe differently."""
    return U64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def signatures(g, d, first, num, nodes):
    """(signature, document, whether the band is the set's own) of all sets in their own and in the next band.

    The band stands in the signature's low bits.
    """
    size = np.diff(first)
    place = band_of(size, num)
    sig, of, mine = [], [], []
    for step in (0, 1):
        for b in np.unique(place[size > 0]) + step:
            n0, n1 = allocation(int(b), num, nodes)
            m = n0 + n1
            hi = band(int(b), num)[1]
            at = np.flatnonzero((place + step == b) & (size > 0))
            count = size[at]
            pos = np.repeat(first[:-1][at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            x, row = g[pos], np.repeat(np.arange(len(at)), count)
            y = mix(x + seed(int(b)))
            cell = row * m + (y % U64(m)).astype(np.int64)
            value = mix(y ^ U64(0x2545F4914F6CDD1D))
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
            total = np.zeros(len(at) * m, np.uint64)
            if len(cell):
                begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                total[cell[begin]] = np.add.reduceat(value, begin)
            keep = np.ones(len(at) * m, bool)
            if not n1:
                # linked sets have more than m - 1 - own equal segments, in the same order of size in both, so
                # each may leave out its m - 1 - own smallest: the largest equal one is among neither's
                own = (count + np.minimum(hi, count * 100 // num)) * (100 - num) // (100 + num)
                filled = np.bincount(cell, minlength=len(at) * m).reshape(len(at), m)
                rank = np.argsort(np.argsort(filled * m + np.arange(m), axis=1), axis=1)
                keep = (rank >= (m - 1 - own)[:, None]).ravel()
            tag = (U64(int(b)) << U64(20)) + (np.arange(len(at) * m) % m).astype(np.uint64)
            gone = (cell % m) >= n0  # every shingle of these segments left out once
            for value_, row_ in ((mix(total + mix(tag))[keep], np.repeat(at, m)[keep]), (mix(total[cell[gone]] - value[gone] + mix(tag[cell[gone]])), at[cell[gone] // m])):
                sig.append(value_ & ~BANDS | U64(int(b)))
                of.append(row_)
                mine.append(np.full(len(row_), step == 0))
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(sig), np.concatenate(of), np.concatenate(mine)


def fine_bytes(s: np.ndarray, b: int, num: int) -> bytes:
    """One byte for each of F segments of a set, in band b."""
    fine = fine_segments(b, num)
    out = np.zeros(fine, np.uint64)
    y = mix(s + seed(b) + U64(99))
    np.add.at(out, (y % U64(fine)).astype(np.int64), mix(y))
    return (out >> U64(40)).astype(np.uint8).tobytes()


def shingle_nodes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, node, hash of the text) of every row; node null for the empty set."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            n, node = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, _, x, o in slices(data, offsets, SIGN_BYTES):
                g, _, first = shingle_sets(x, o, k)
                n.append(np.diff(first))
                node.append(node_ids(g, first))
            n, node = np.concatenate(n), np.concatenate(node)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node.view(np.int64), pa.int64(), mask=n == 0), b.column(2)], names=["id", "n_shingles", "node", "text_hash"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return plain.mapInArrow(trimmed(run), "id long, n_shingles long, node long, text_hash long")


def candidate_groups(docs: DataFrame, k: int, num: int, text_col: str, count: int) -> DataFrame:
    """(group, node): nodes that share a signature, of about ``count`` nodes; groups of the same members are one."""
    parts = partitions(docs.sparkSession)

    def sign(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for _, _, x, o in slices(data, offsets, SIGN_BYTES):
                g, d, first = shingle_sets(x, o, k)
                sig, of, mine = signatures(g, d, first, num, count)
                node = node_ids(g, first)[of] | mine
                bucket = (sig >> U64(33)) % U64(parts)
                order = np.lexsort((node, sig, bucket))
                sig, node, bucket = sig[order], node[order], bucket[order]
                new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])] if len(sig) else np.zeros(0, bool)
                sig, node, bucket = sig[new], node[new], bucket[new]
                cut = np.searchsorted(bucket, np.arange(parts + 1).astype(np.uint64))
                rows = [i for i in range(parts) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int32()), pa.array([np.stack([sig[cut[i] : cut[i + 1]], node[cut[i] : cut[i + 1]]]).tobytes() for i in rows], pa.binary())], names=["bucket", "pairs"])

    def gather(batches):
        held: dict[int, list] = {}
        for b in batches:
            for bucket, pairs in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(bucket, []).append(np.frombuffer(pairs.as_py(), np.uint64).reshape(2, -1))
        for bucket in sorted(held):
            sig, node = np.concatenate(held.pop(bucket), axis=1)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node = sig[new], node[new]
            begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[begin, len(sig)])
            many = np.repeat(size > 1, size)
            sig, node = sig[many], node[many]
            if not len(sig):
                continue
            begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[begin, len(sig)])
            own = np.add.reduceat((node & U64(1)).astype(np.int64), begin) > 0
            node = node & ~U64(1)
            whole = mix(np.add.reduceat(mix(node), begin) + size.astype(np.uint64)) & ~BANDS | sig[begin] & BANDS  # the same members: the same group
            first = np.zeros(len(whole), bool)
            first[np.unique(whole, return_index=True)[1]] = True
            first &= own  # sets of the band below meet there
            keep = np.repeat(first, size)
            if not keep.any():
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(whole, size)[keep].view(np.int64)), pa.array(node[keep].view(np.int64))], names=["group", "node"])

    blobs = docs.select(F.col(text_col).alias("text")).mapInArrow(trimmed(sign), "bucket int, pairs binary").repartition(parts, "bucket")
    return blobs.mapInArrow(trimmed(gather), "group long, node long").dropDuplicates(["group", "node"])


def node_sets(docs: DataFrame, reps: DataFrame, k: int, num: int, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(node, n, band, fine0, fine1, members) of the texts that ``reps`` (id, hash of the text) names."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    reps = reps.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    small = reps.count() <= broadcast_rows
    chosen = plain.join(F.broadcast(reps) if small else reps, (F.xxhash64("text") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for _, _, x, o in slices(data, offsets, SIGN_BYTES):
                out = []
                g, _, first = shingle_sets(x, o, k)
                own, node = band_of(np.diff(first), num), node_ids(g, first).view(np.int64)
                for i in range(len(first) - 1):
                    s = g[first[i] : first[i + 1]]
                    if len(s):
                        out.append((int(node[i]), len(s), int(own[i]), fine_bytes(s, int(own[i]), num), fine_bytes(s, int(own[i]) + 1, num), s.tobytes()))
                cols = list(zip(*out)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["node", "n", "band", "fine0", "fine1", "members"])

    return chosen.mapInArrow(trimmed(run), "node long, n long, band int, fine0 binary, fine1 binary, members binary").dropDuplicates(["node"])


def passing_pairs(groups: DataFrame, nodes: DataFrame, num: int, first_round: bool) -> DataFrame:
    """(a, b) pairs of a group that the finer segments don't exclude; ``groups``: (group, node, label).

    First round: the ``FIRST`` most alike partners of each node in the group; else all pairs of different labels.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("_size"), F.min("label").alias("_l"), F.max("label").alias("_h"))
    fine = F.length(F.col("fine"))
    place = F.col("group").bitwiseAND(F.lit(int(BANDS))).cast("int")
    sets = nodes.select("node", "n", F.explode(F.array(F.struct(F.col("band").alias("_band"), F.lit(True).alias("own"), F.col("fine0").alias("fine")), F.struct((F.col("band") + 1).alias("_band"), F.lit(False).alias("own"), F.col("fine1").alias("fine")))).alias("_s")).select("node", "n", "_s.*")
    work = groups.join(sizes.where("_size > 1 and _l < _h").select("group", "_size"), "group").withColumn("_band", place).join(sets, ["node", "_band"])
    work = work.withColumn("_blocks", F.ceil(F.col("_size") / F.least(F.lit(BLOCK), F.ceil(F.lit(BLOCK_BYTES) / fine))).cast("int"))
    work = work.withColumn("_at", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    work = work.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    work = work.withColumn("_x", F.least("_at", "_other")).withColumn("_y", F.greatest("_at", "_other")).select("group", "_x", "_y", "_at", "node", "label", "n", "own", "fine")
    parts = partitions(groups.sparkSession)
    keys = ["group", "_x", "_y"]

    def pairs(at, node, label, n, own, fine, x, y):
        """Of one group and pair of blocks; a pair of two sets of the band below is met there."""
        left, right = (np.arange(len(at)),) * 2 if x == y else (np.flatnonzero(at == x), np.flatnonzero(at == y))
        step, found = max(1, (1 << 22) // max(1, fine.shape[1])), []
        for lo in range(0, len(left), 64):
            l = left[lo : lo + 64]
            most = (n[l][:, None] + n[right][None]) * (100 - num) // (100 + num)
            ok = (node[l][:, None] != node[right][None]) & (label[l][:, None] != label[right][None]) & (own[l][:, None] | own[right][None])
            i, j = np.nonzero(ok)
            far = np.empty(len(i), np.int64)
            for s in range(0, len(i), step):
                far[s : s + step] = np.count_nonzero(fine[l[i[s : s + step]]] != fine[right[j[s : s + step]]], axis=1)
            good = far <= most[i, j]
            i, j, far = i[good], j[good], far[good]
            if first_round:
                order = np.lexsort((far, i))
                i, j = i[order], j[order]
                near = np.arange(len(i)) - np.searchsorted(i, i) < FIRST
                i, j = i[near], j[near]
            found.append(np.stack([node[l[i]], node[right[j]]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return np.unique(np.sort(both, axis=0), axis=1) if both.shape[1] else both

    def run(batches):
        held = None

        def flush(table):
            cols = {c: table.column(c).to_numpy() for c in (*keys, "_at", "node", "label", "n", "own")}
            key = np.stack([cols[c] for c in keys])
            cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, table.num_rows]
            out = []
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s > 1:
                    raw = np.frombuffer(b"".join(x.as_py() for x in table.column("fine").slice(s, e - s)), np.uint8).reshape(e - s, -1)
                    out.append(pairs(*(cols[c][s:e] for c in ("_at", "node", "label", "n", "own")), raw, cols["_x"][s], cols["_y"][s]))
            both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            both = np.unique(both, axis=1) if both.shape[1] else both
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(c)[held.num_rows - 1].as_py() for c in keys]
            same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(keys, last)])
            cut = int(same.argmax())
            if cut:
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield flush(held)

    ready = work.repartition(parts, *keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(trimmed(run), "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, num: int) -> DataFrame:
    """The pairs whose whole sets have 100 * intersection >= num * union."""
    sets = nodes.select("node", "members")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("_s")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("_t")), "b")

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                ok[i] = 100 * common >= num * (len(s) + len(t) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "_s", "_t").mapInArrow(trimmed(run), "a long, b long")


def jaccard_rows(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, node, text_hash) of every row, and (node, component, id, text_hash) of every set with the row that stands for it."""
    rows = materialize(shingle_nodes(docs, k, id_col, text_col), "nodes")
    # a node's row: rows with an id before those without, so that copies without one are hashed once
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("_row")
    least = materialize(rows.where("node is not null").groupBy("node").agg(first).select("node", "_row.id", "_row.text_hash"), "least")
    groups = materialize(candidate_groups(docs, k, percent, text_col, 1 << least.count().bit_length()), "groups")
    reps = least.join(groups.select("node").distinct(), "node", "left_semi")
    nodes = materialize(node_sets(docs, reps.select("id", "text_hash"), k, percent, id_col, text_col, broadcast_rows), "sets")
    passed = materialize(passing_pairs(groups.withColumn("label", F.col("node")), nodes, percent, True), "pairs")
    links = materialize(verified(passed, nodes, percent), "links")
    labels = materialize(connected_components(links, "parts"), "labels")
    rest = groups.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("label"))
    again = materialize(passing_pairs(rest, nodes, percent, False), "pairs")
    more = materialize(verified(again, nodes, percent), "links")
    discard(passed, again, nodes, groups)
    if more.limit(1).count():
        labels = materialize(connected_components(links.unionByName(more), "parts"), "labels")
    return rows, least.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "id", "text_hash")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id: the smallest id reachable by links."""
    rows, sets = jaccard_rows(docs, k, percent, id_col, text_col, broadcast_rows)
    smallest = sets.groupBy("component").agg(F.min("id").alias("component_id"))
    named = sets.join(smallest, "component").select("node", "component_id")
    out = rows.join(named, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest id (rows without one come last).

    Rows without words all stay.  What goes is found by id and text, so another row of the same id isn't touched.
    """
    rows, sets = jaccard_rows(docs, k, percent, id_col, text_col, broadcast_rows)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "node")
    kept = sets.groupBy("component").agg(F.min(order).alias("_k")).select(F.col("_k.node").alias("node"), F.col("_k.id").alias("_kid"), F.col("_k.text_hash").alias("_khash"))
    own = rows.where("node is not null").join(kept, "node", "left")
    stays = F.col("_khash").isNotNull() & F.col("id").eqNullSafe(F.col("_kid")) & (F.col("text_hash") == F.col("_khash"))
    gone = materialize(own.where(~stays).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    out = docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, same, "left_anti")
    twice = materialize(own.where(stays).groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "twice")
    if not twice.limit(1).count():
        return out
    many = out.join(twice, same, "left_semi").withColumn("_of", F.xxhash64(text_col)).dropDuplicates([id_col, "_of"]).drop("_of")
    return out.join(twice, same, "left_anti").unionByName(many)
