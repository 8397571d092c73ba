"""Quality classifier: a byte-level convolutional network in numpy.

Learned byte embeddings feed learned filters over ``WIDTH`` bytes.  A document is cut into cells of
``CELL`` positions; two neighbouring cells form a chunk, so that chunks overlap by half and cover the
whole document.  Each filter is max-pooled over each chunk, a dense layer follows, and the mean and
the maximum over all chunks are combined into one probability.

Null and empty texts have no chunk; their features are zeros, so they all get one defined score.
Ties and repeated rows get equal scores.  Extra columns are ignored; an empty table gives no rows.
Without labelled rows of both classes the network stays as drawn and the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import slices, small_batches, text_buffers, trimmed

WIDTH, DIM, FILTERS, CELL, HIDDEN = 7, 4, 16, 128, 16


class ByteConv:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (257, DIM)).astype(f),
            "w": r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f),
            "b": np.zeros(FILTERS, f),
            "w1": r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "out": r.normal(0, 0.3, 2 * HIDDEN).astype(f),
            "bias": np.zeros(1, f),
        }
        self.scale, self.shift = np.ones(2 * HIDDEN, f), np.zeros(2 * HIDDEN, f)

    def cells(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima of each cell, and the document of each cell."""
        size = np.diff(offsets)
        count = -(-size // CELL)
        doc = np.repeat(np.arange(len(size)), count)
        if not len(doc):
            return np.zeros((0, FILTERS), np.float32), doc
        pad = WIDTH - 1
        at = np.arange(len(data)) + np.repeat(np.arange(len(size)) * pad, size)
        padded = np.full(len(data) + pad * len(size), 256, np.int16)  # 256 stands for "past the end"
        padded[at] = data
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[doc] + doc * pad + rank * CELL
        length = np.minimum(CELL, size[doc] - rank * CELL)
        x = self.p["emb"][padded]
        out, step = np.empty((len(doc), FILTERS), np.float32), 512
        for lo in range(0, len(doc), step):
            a, b = start[lo], start[min(lo + step, len(doc)) - 1] + length[min(lo + step, len(doc)) - 1]
            seen = np.lib.stride_tricks.as_strided(x[a:], (b - a, WIDTH * DIM), (x.strides[0], x.strides[1]))
            z = seen @ self.p["w"]
            s = start[lo : lo + step] - a
            e = s + length[lo : lo + step]
            gaps = np.empty(2 * len(s), np.int64)
            gaps[::2], gaps[1::2] = s, e
            if gaps[-1] >= len(z):
                gaps = gaps[:-1]
            out[lo : lo + step] = np.maximum.reduceat(z, gaps, axis=0)[::2]
        return out, doc

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean and maximum over all chunks of the dense layer, per document; zeros for empty ones."""
        n = len(offsets) - 1
        out = np.zeros((n, 2 * HIDDEN), np.float32)
        cell, doc = self.cells(data, offsets)
        if not len(doc):
            return out
        last = np.r_[doc[1:] != doc[:-1], True]
        first = np.r_[True, doc[1:] != doc[:-1]]
        pair = np.maximum(cell, np.r_[cell[1:], cell[-1:]])
        keep = ~last | (first & last)  # a document of one cell is one chunk
        pair[first & last] = cell[first & last]
        chunk, doc = pair[keep], doc[keep]
        h = np.maximum(np.maximum(chunk + self.p["b"], 0) @ self.p["w1"] + self.p["b1"], 0)
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[begin, len(doc)])
        out[doc[begin], :HIDDEN] = np.add.reduceat(h, begin, axis=0) / size[:, None]
        out[doc[begin], HIDDEN:] = np.maximum.reduceat(h, begin, axis=0)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.features(data, offsets).astype(np.float64) - self.shift) / self.scale
        z = (x * self.p["out"]).sum(1) + self.p["bias"]
        return np.round(1 / (1 + np.exp(-np.clip(z, -35, 35))), 6)  # beyond what single precision settles

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int, seed: int = 11) -> ByteConv:
        """Adam on batches of chunks drawn from anywhere in the sample's texts; then the last layer on whole texts."""
        labels = np.asarray(labels, np.float32)
        if len(set(labels.tolist())) < 2:
            self.p["out"][:] = 0
            return self
        r, p = np.random.default_rng(seed), self.p
        pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        arrays = [np.frombuffer(t, np.uint8) for t in texts]
        pos, neg = (x[[len(arrays[i]) > 0 for i in x]] for x in (pos, neg))
        if not len(pos) or not len(neg):
            return self
        head = {"v": r.normal(0, 0.3, HIDDEN).astype(np.float32), "c": np.zeros(1, np.float32)}
        all_p = {k: p[k] for k in ("emb", "w", "b", "w1", "b1")} | head
        m, v = ({k: np.zeros_like(x) for k, x in all_p.items()} for _ in range(2))
        span = 2 * CELL
        for step in range(1, steps + 1):
            pick = np.r_[r.choice(pos, 32), r.choice(neg, 32)]
            y = labels[pick]
            grid = np.full((len(pick), span + WIDTH - 1), 256, np.int64)
            size = np.empty(len(pick), np.int64)
            for row, i in enumerate(pick):
                a = arrays[i]
                s = int(r.integers(0, max(1, len(a) - span + 1)))
                part = a[s : s + span + WIDTH - 1]
                grid[row, : len(part)] = part
                size[row] = min(span, len(a) - s)
            x = p["emb"][grid]
            seen = np.lib.stride_tricks.as_strided(x, (len(pick), span, WIDTH * DIM), (x.strides[0], x.strides[1], x.strides[2]))
            z = seen @ p["w"]
            z[np.arange(span)[None, :] >= size[:, None]] = -1e9
            top = z.argmax(1)
            c = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p["b"]
            a0 = np.maximum(c, 0)
            h = a0 @ p["w1"] + p["b1"]
            a1 = np.maximum(h, 0)
            q = 1 / (1 + np.exp(-np.clip(a1 @ head["v"] + head["c"], -30, 30)))
            d = ((q - y) / len(pick)).astype(np.float32)
            g = {"v": a1.T @ d, "c": d.sum(keepdims=True)}
            dh = np.outer(d, head["v"]) * (h > 0)
            g["w1"], g["b1"] = a0.T @ dh, dh.sum(0)
            dc = (dh @ p["w1"].T) * (c > 0)
            g["b"] = dc.sum(0)
            won = seen[np.arange(len(pick))[:, None], top]  # rows, filters, WIDTH * DIM
            g["w"] = np.einsum("rf,rfk->kf", dc, won)
            back = (dc[:, :, None] * p["w"].T[None]).reshape(len(pick), FILTERS, WIDTH, DIM)
            g["emb"] = np.zeros_like(p["emb"])
            byte = grid[np.arange(len(pick))[:, None, None], top[:, :, None] + np.arange(WIDTH)]
            np.add.at(g["emb"], byte.ravel(), back.reshape(-1, DIM))
            for k, x in all_p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
        feats = np.concatenate([self.features(d, o) for _, _, d, o in slices(buffer, offsets)])
        self.shift, self.scale = feats.mean(0), feats.std(0) + 0.05
        p["out"][:], p["bias"][:] = logistic((feats - self.shift) / self.scale, labels)
        return self


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps."""
    a = np.c_[x.astype(np.float64), np.ones(len(x))]
    w, pen = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (q * (1 - q))[:, None]).T @ a + np.diag(pen)
        w -= np.linalg.solve(h, a.T @ (q - y) + pen * w)
    return w[:-1].astype(np.float32), np.float32(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, rows: dict[int, int]) -> tuple[list[bytes], np.ndarray, float]:
    """At most ``rows[y]`` training texts of each class y, by the order of a hash; the held-out fold is never read.

    The bound is the documented limit on what a classifier learns from; everything is scored.  Of repeated ids the
    least label and the least text count; rows without an id are not learned from.  The third value
    is the log odds of class 1 over the whole training fold less that in the sample, for honest probabilities.
    """
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held).select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = [train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[y]) for y in (0, 1)]
    keys = chosen[0].unionByName(chosen[1])
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toPandas()
    y, whole = found.y.to_numpy(np.float32), {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    odds = lambda one, none: np.log(max(one, 1) / max(none, 1))
    return [t.encode() for t in found.text], y, float(odds(whole.get(1, 0), whole.get(0, 0)) - odds(y.sum(), (1 - y).sum()))


def score_quality(docs: DataFrame, net: ByteConv, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score) for each row of ``docs``: the probability that its whole text is of good quality."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            parts = [net.score(d, o) for _, _, d, o in slices(data, offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=["id", "score"])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), "id long, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, net: ByteConv, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is ``threshold`` or more; without a shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(at))
            parts = [net.score(d, o) for _, _, d, o in slices(data, offsets, 1 << 20)]
            yield b.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = 1000, steps: int = 700) -> ByteConv:
    """Learn from at most ``rows`` labelled texts of each class whose crc32(doc_id) mod 5 is not 0."""
    texts, y, prior = labelled_sample(docs, labels, "quality", 5, 0, {0: rows, 1: rows})
    net = ByteConv().fit(texts, y, steps)
    if 0 < y.sum() < len(y):
        net.p["bias"] += prior
    return net
