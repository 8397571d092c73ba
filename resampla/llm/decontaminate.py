"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact check.

For each benchmark item, every window of its number of five-word shingles in every document that
could reach the similarity gets a 64-bit SimHash (the sign of each bit's sum over the window's shingles, counted as
often as they occur), read off running sums.  A window can reach it only if enough of its shingles are an item's, so
all others are passed over first; that loses nothing.  The 64 bits are split into ``BLOCKS`` = 6 blocks of 11 or 10.
Two fingerprints within ``REACH`` = 23 bits differ by at most three in one of the blocks, so a table of all values
within three flips of an item's block, one per block, passes every window within reach; a popcount settles
the rest.  Windows within reach are verified by the exact weighted Jaccard similarity of their shingles
(weights: multiplicities), 0.8 or more.  Windows of just 0.8 differ by 9.5 bits in the mean; the README gives the recall.

Words are maximal runs of letters, digits and non-ASCII bytes with A-Z lowered, so punctuation, case
and line ends don't hide a passage.  A document shorter than an item is one window of its own.  Items
under five words have no shingle and match nothing; the same holds for null and empty texts.  Items without
an id are left out, and items that repeat an id with other texts are all searched.  Extra columns are ignored
(``remove_contaminated`` keeps them); empty tables find nothing.  Items
are searched in passes of ``ITEMS`` over the documents, so what is sent to executors has a bound and
the benchmark may be of any size.  There is no shuffle; repeated rows are reported each.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm import common
from resampla.llm.common import LOWER, U64, prefix_hash, slices, small_batches, span_hash, text_buffers, trimmed

SHINGLE, RADIUS, SIMILARITY, ITEMS = 5, 15, 0.8, 2000
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit and width
REACH = len(BLOCKS) * (RADIUS // 4 + 1) - 1  # four blocks would reach RADIUS
WORD = np.zeros(256, bool)
WORD[128:] = True
WORD[[*range(48, 58), *range(97, 123)]] = True
FLIPS = np.array([sum(1 << b for b in c) for k in range(RADIUS // 4 + 1) for c in combinations(range(16), k)], np.uint16)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in order, and the number of each document's first shingle (with the total last)."""
    low = LOWER[data]
    blank = np.where(WORD[low], low, 32).astype(np.uint8)
    starts, ends, docs = common.words(blank, offsets)
    h = span_hash(prefix_hash(blank), starts, ends)
    n = len(offsets) - 1
    at = np.arange(max(0, len(h) - SHINGLE + 1))
    if len(at):
        at = at[docs[at] == docs[at + SHINGLE - 1]]
    g = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        g = common.mix(g * common._BASE + h[at + j] + U64(j + 1))
    return g, np.searchsorted(docs[at], np.arange(n + 1))


def running_sums(g: np.ndarray, wide: bool = False) -> np.ndarray:
    """Row i: per bit, the ones among the first i shingles, modulo 2**16 (differences below that stay exact) where ``wide`` is not needed."""
    bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    out = np.zeros((len(g) + 1, 64), np.uint32 if wide else np.uint16)
    for lo in range(0, len(g), 255):  # eight one-byte sums in a word cannot overflow within 255 rows
        part = np.cumsum(bits[lo : lo + 255], axis=0).view(np.uint8)
        np.add(part, out[lo], out=out[lo + 1 : lo + 1 + len(part)])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each start to its end: a bit is set if more than half of them have it."""
    bits = sums[ends] - sums[starts] > ((ends - starts) // 2).astype(sums.dtype)[:, None]
    return np.packbits(bits.ravel()).view(np.uint64)


def least_shared(size, window):
    """The fewest shingles that an item of ``size`` and a window must share to be similar enough."""
    return np.ceil(SIMILARITY * (size + window) / (1 + SIMILARITY) - 1e-9).astype(np.int64)


class Index:
    """Items of one pass: by window size, their fingerprints, block tables and shingle multisets."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        g, first = shingle_hashes(data, offsets)
        self.by_size: dict[int, tuple] = {}
        sizes = np.diff(first)
        for size in sorted(set(sizes[sizes > 0].tolist())):
            rows = np.flatnonzero(sizes == size)
            prints, items = [], []
            for r in rows:
                own = g[first[r] : first[r + 1]]
                prints.append(fingerprints(running_sums(own, size >= 1 << 16), np.array([0]), np.array([size]))[0])
                items.append((ids[r], *np.unique(own, return_counts=True)))
            prints = np.array(prints, np.uint64)
            near = []
            for first_bit, width in BLOCKS:
                value = (prints >> U64(first_bit)) & U64((1 << width) - 1)
                table = np.zeros(1 << width, bool)
                table[(value[:, None] ^ FLIPS[FLIPS < 1 << width].astype(np.uint64)[None]).ravel()] = True
                near.append(table)
            self.by_size[size] = (prints, near, items, np.unique(np.concatenate([kinds for _, kinds, _ in items])))
        self.known = np.unique(g)
        self.mark = np.zeros(1 << 20, bool)
        self.mark[self.known >> U64(44)] = True

    @staticmethod
    def among(known, g, at):
        """Those of the positions whose shingles are known."""
        return at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]] if len(known) else at[:0]

    @staticmethod
    def near_any(near, prints):
        """Positions of the fingerprints with a block within three flips of an item's."""
        out = np.zeros(len(prints), bool)
        for (first_bit, width), table in zip(BLOCKS, near):
            out |= table[(prints >> U64(first_bit)) & U64((1 << width) - 1)]
        return np.flatnonzero(out)

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(document, item, similarity, first shingle) of each matching document and item, at its best window."""
        g, first = shingle_hashes(data, offsets)
        if not len(g):
            return []
        sums, count, best = None, np.diff(first), {}
        own = self.among(self.known, g, np.flatnonzero(self.mark[g >> U64(44)]))
        shared = np.zeros(len(g) + 1, np.int32)  # entry i: how many of the first i shingles are an item's
        shared[own + 1] = 1
        np.cumsum(shared, out=shared)
        doc = np.repeat(np.arange(len(count)), count)
        for size, (prints, near, items, known) in self.by_size.items():
            hit = np.flatnonzero(shared[size:] - shared[:-size] >= least_shared(size, size))
            hit = hit[doc[hit] == doc[hit + size - 1]]
            small = np.flatnonzero((count >= math.ceil(SIMILARITY * size)) & (count < size))
            small = small[shared[first[small + 1]] - shared[first[small]] >= least_shared(size, count[small])]
            begin, stop = np.r_[hit, first[small]], np.r_[hit + size, first[small + 1]]
            if len(begin):  # the same count, of the shingles of this size's items
                mine = self.among(known, g, own)
                enough = np.searchsorted(mine, stop) - np.searchsorted(mine, begin) >= least_shared(size, stop - begin)
                begin, stop = begin[enough], stop[enough]
            if not len(begin):
                continue
            if sums is None:
                sums = running_sums(g, max(self.by_size) >= 1 << 16)
            p = fingerprints(sums, begin, stop)
            at = self.near_any(near, p)
            begin, stop, p = begin[at], stop[at], p[at]
            for print_, (item, kinds, times) in zip(prints, items):
                for w in np.flatnonzero(np.bitwise_count(p ^ print_) <= REACH):
                    s, e = begin[w], stop[w]
                    have, often = np.unique(g[s:e], return_counts=True)
                    at = np.minimum(np.searchsorted(kinds, have), len(kinds) - 1)
                    both = np.where(kinds[at] == have, np.minimum(times[at], often), 0).sum()
                    like = both / (size + (e - s) - both)
                    key = (int(doc[s]), item)
                    if like >= SIMILARITY and like > best.get(key, (0,))[0]:
                        best[key] = (like, int(s - first[doc[s]]))
        return [(d, i, like, at) for (d, i), (like, at) in best.items()]


def indexes(benchmark: DataFrame, item_col: str, item_text: str):
    """Indexes of the items in the order of their ids, a bounded block at a time; one at least."""
    last, some = None, False
    while True:
        rest = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null")
        rows = (rest if last is None else rest.where(F.col("i") > last)).groupBy("i").agg(F.collect_set("t").alias("t")).orderBy("i").limit(ITEMS).collect()
        if rows or not some:
            flat = [(r["i"], t) for r in rows for t in sorted(r["t"])]
            yield Index([i for i, _ in flat], [t for _, t in flat])
        if len(rows) < ITEMS:
            return
        last, some = rows[-1]["i"], True


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, similarity, word): the documents that hold a benchmark item, with the best window's first word."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(benchmark, item_col, item_text):

        def run(batches, index=index):
            for b in batches:
                data, offsets = text_buffers(b.column(1))
                ids, out = b.column(0).to_pylist(), []
                for lo, _, d, o in slices(data, offsets, 1 << 20):
                    out += [(ids[lo + k], i, like, at) for k, i, like, at in index.search(d, o)]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["id", "item", "similarity", "word"])

        found = plain.mapInArrow(trimmed(run), "id long, item long, similarity double, word long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no benchmark item; without a shuffle or a join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, item_col, item_text):

        def run(batches, index=index):
            for b in batches:
                data, offsets = text_buffers(b.column(at))
                clean = np.ones(b.num_rows, bool)
                for lo, _, d, o in slices(data, offsets, 1 << 20):
                    clean[[lo + k for k, *_ in index.search(d, o)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
