"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is read twice: as a word (a hashed embedding of its identity) and as characters (the mean
of hashed embeddings of its 4-byte pieces and of its first and last 3 to 5 bytes), so that inflected or
disguised forms share what was learned.  Windows of ``WINDOW`` words, each overlapping the next by
``WINDOW - STRIDE``, cover the whole text; every one is scored by a forward and a backward gated recurrent pass and
an attention-weighted sum of their states.  The document's probability is a logistic function of
its highest window, its smooth maximum, and the expected numbers of toxic windows by count and share.

Null, empty and blank texts have no window; they get the defined score of a document whose windows
are all as clean as the cleanest training document.  Repeated rows get equal scores, extra columns
are ignored, an empty table gives no rows.  Without labels of both classes the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import LOWER, U64, distinct, mix, powers, prefix_hash, slices, small_batches, span_hash, text_buffers, trimmed, words
from resampla.llm.quality import labelled_sample, logistic

WINDOW, STRIDE, DIM, H, BUCKETS = 16, 8, 16, 8, 1 << 14


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def vocabulary(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a slice: (word of each position, document of each position, word bucket, piece buckets, pieces per word)."""
    low = LOWER[data]
    starts, ends, docs = words(low, offsets)
    prefix = prefix_hash(low)
    h = span_hash(prefix, starts, ends)
    first, word = distinct(h)
    kinds = h[first]
    s, e = starts[first], ends[first]
    size = np.maximum(e - s, 1)
    whole = (kinds % U64(BUCKETS)).astype(np.int64)
    _, down = powers(len(prefix))
    pieces, owner = [], []
    n = len(kinds)
    # all pieces of 4 bytes; the word's first and last pieces of 3 to 5 bytes are hashed apart from inner ones
    at = np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = np.repeat(np.arange(n), size)
    for k in (3, 4, 5):
        if k == 4:
            fits = at + k <= e[own]
            a, o = at[fits], own[fits]
            pieces.append((mix((prefix[a + k] - prefix[a]) * down[a]) % U64(BUCKETS)).astype(np.int64))
            owner.append(o)
        o = np.flatnonzero(e - s >= k)
        for a, mark in ((s[o], 100 + k), (e[o] - k, 200 + k)):
            pieces.append((mix((prefix[a + k] - prefix[a]) * down[a] + U64(mark)) % U64(BUCKETS)).astype(np.int64))
            owner.append(o)
    piece = np.concatenate([whole, *pieces])  # the whole word is a piece too, so that no word is without
    owner = np.concatenate([np.arange(n), *owner])
    order = np.argsort(owner, kind="stable")
    piece, count = piece[order], np.bincount(owner, minlength=n)
    return word, docs, whole, piece, count


def scatter(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows summed by their index, as an array of ``n`` rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def windows(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, document) of all windows: overlapping, the last of a document reaching its end."""
    if not len(docs):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    size = np.diff(np.r_[first, len(docs)])
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(first, count) + rank * STRIDE
    return begin, np.minimum(WINDOW, np.repeat(size, count) - rank * STRIDE), np.repeat(docs[first], count)


class BiGru:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 3):
        r, f = np.random.default_rng(seed), np.float32
        self.p = {
            "word": r.normal(0, 0.1, (BUCKETS, DIM)).astype(f),
            "char": r.normal(0, 0.3, (BUCKETS, DIM)).astype(f),
            "wx": r.normal(0, DIM**-0.5, (2, DIM, 3 * H)).astype(f),
            "bx": np.zeros((2, 1, 3 * H), f),
            "u": r.normal(0, H**-0.5, (2, H, 3 * H)).astype(f),
            "att": r.normal(0, 0.3, (2 * H, H)).astype(f),
            "query": r.normal(0, 0.5, H).astype(f),
            "out": r.normal(0, 0.5, 2 * H).astype(f),
            "bias": np.full(1, -1, f),
        }
        self.final, self.offset, self.mean, self.std = np.zeros(4, f), f(0), np.zeros(4, f), np.ones(4, f)

    def inputs(self, whole, piece, count):
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros((0, DIM), np.float32)
        return self.p["word"][whole] + np.add.reduceat(self.p["char"][piece], ends - count, axis=0) / count[:, None].astype(np.float32)

    def forward(self, x, mask, keep=False):
        """x: (T, N, DIM) or ready projections (2, T, N, 3H); mask (T, N). Window logits, and what the backward pass needs."""
        p = self.p
        g = x if x.ndim == 4 else np.stack([x, x[::-1]]) @ p["wx"][:, None] + p["bx"][:, None]
        m = np.stack([mask, mask[::-1]]).astype(np.float32)
        steps, n = mask.shape
        h, hs, saved = np.zeros((2, n, H), np.float32), np.empty((2, steps, n, H), np.float32), []
        for t in range(steps):
            hu = h @ p["u"]
            zr = sigmoid(g[:, t, :, : 2 * H] + hu[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(g[:, t, :, 2 * H :] + r * hu[..., 2 * H :])
            new = h + m[:, t, :, None] * z * (c - h)
            if keep:
                saved.append((h, hu, z, r, c))
            h = hs[:, t] = new
        both = np.concatenate([hs[0], hs[1, ::-1]], axis=2)  # T, N, 2H
        a = np.tanh(both @ p["att"])
        e = np.where(mask, a @ p["query"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnk->nk", w, both)
        logit = pooled @ p["out"] + p["bias"]
        return logit, (g, m, saved, both, a, w, pooled)

    def backward(self, x, d, kept):
        """Gradients of sum(d * logit) in all parameters but the tables, and in x."""
        p = self.p
        _, m, saved, both, a, w, pooled = kept
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = np.outer(d, p["out"])
        dboth = w[..., None] * dp[None]
        dw = np.einsum("tnk,nk->tn", both, dp)
        de = w * (dw - (w * dw).sum(0))
        g["query"] = de.ravel() @ a.reshape(-1, H)
        da = de[..., None] * p["query"] * (1 - a * a)
        g["att"] = both.reshape(-1, 2 * H).T @ da.reshape(-1, H)
        dboth = dboth + da @ p["att"].T
        dhs = np.stack([dboth[..., :H], dboth[::-1, :, H:]])
        dh, du, dg = np.zeros_like(dhs[:, 0]), np.zeros_like(p["u"]), np.empty((*dhs.shape[:3], 3 * H), np.float32)
        for t in reversed(range(len(saved))):
            h, hu, z, r, c = saved[t]
            dh = dh + dhs[:, t]
            mt = m[:, t, :, None]
            dz, dc = dh * mt * (c - h) * z * (1 - z), dh * mt * z * (1 - c * c)
            dr = dc * hu[..., 2 * H :] * r * (1 - r)
            dg[:, t] = np.concatenate([dz, dr, dc], axis=2)
            dhu = np.concatenate([dz, dr, dc * r], axis=2)
            du += h.transpose(0, 2, 1) @ dhu
            dh = dh * (1 - mt * z) + dhu @ p["u"].transpose(0, 2, 1)
        g["u"], g["bx"] = du, dg.sum((1, 2))[:, None]
        g["wx"] = np.stack([v.reshape(-1, DIM).T @ w.reshape(-1, 3 * H) for v, w in ((x, dg[0]), (x[::-1], dg[1]))])
        dx = dg @ p["wx"].transpose(0, 2, 1)[:, None]
        return g, dx[0] + dx[1, ::-1]

    def window_logits(self, data, offsets):
        """Logits of all windows and their documents."""
        word, docs, whole, piece, count = vocabulary(data, offsets)
        begin, size, owner = windows(docs)
        out = np.empty(len(begin), np.float32)
        if len(begin):
            # the input projections are the same wherever a word stands: one row for each distinct word
            x = self.inputs(whole, piece, count)
            proj = np.stack([x @ self.p["wx"][d] + self.p["bx"][d] for d in (0, 1)])
            for lo in range(0, len(begin), 1024):
                b, s = begin[lo : lo + 1024], size[lo : lo + 1024]
                at = word[np.minimum(b[None] + np.arange(WINDOW)[:, None], len(word) - 1)]
                mask = np.arange(WINDOW)[:, None] < s[None]
                out[lo : lo + 1024] = self.forward(np.stack([proj[0][at], proj[1][at[::-1]]]), mask)[0]
        return out, owner

    def features(self, data, offsets):
        """Per document: highest window logit, smooth maximum, log expected count and share of toxic windows."""
        n = len(offsets) - 1
        s, owner = self.window_logits(data, offsets)
        top, total, soft, k = np.full(n, np.nan), np.zeros(n), np.zeros(n), np.bincount(owner, minlength=n)
        if len(s):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            at = owner[first]
            s = s.astype(np.float64)
            top[at] = np.maximum.reduceat(s, first)
            total[at] = np.add.reduceat(sigmoid(s), first)
            soft[at] = np.log(np.add.reduceat(np.exp(s - top[owner]), first)) + top[at]
        return np.c_[top, soft, np.log1p(total), np.sqrt(total / np.maximum(k, 1))]

    def score(self, data, offsets):
        f = self.features(data, offsets)
        f = np.where(np.isnan(f[:, :1]), self.floor if hasattr(self, "floor") else 0.0, f)
        z = ((f - self.mean) / self.std * self.final).sum(1) + self.offset
        return np.round(sigmoid(z.astype(np.float64)), 6)  # beyond what single precision settles

    def fit(self, texts: list[bytes], labels, steps: int, bag: int = 24, seed: int = 5) -> BiGru:
        """Adam on the smooth maximum over runs of windows drawn from anywhere in a text; then the document layer on whole texts."""
        y = np.asarray(labels, np.float32)
        r, p = np.random.default_rng(seed), self.p
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        word, docs, whole, piece, count = vocabulary(buffer, offsets)
        begin, size, owner = windows(docs)
        span = np.searchsorted(owner, np.arange(len(texts) + 1))
        full = np.flatnonzero(np.diff(span) > 0)
        pos, neg = full[y[full] == 1], full[y[full] == 0]
        if not len(pos) or not len(neg):
            return self
        piece_at = np.cumsum(count) - count
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick, win, own = np.r_[r.choice(pos, 12), r.choice(neg, 12)], [], []
            for j, i in enumerate(pick):
                lo, hi = span[i], span[i + 1]
                lo = lo + int(r.integers(0, max(1, hi - lo - bag + 1)))
                win.append(np.arange(lo, min(hi, lo + bag)))
                own.append(np.full(len(win[-1]), j))
            win, own = np.concatenate(win), np.concatenate(own)
            at = word[np.minimum(begin[win][None] + np.arange(WINDOW)[:, None], len(word) - 1)]
            mask = np.arange(WINDOW)[:, None] < size[win][None]
            kinds, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            cnt = count[kinds]
            sub = np.repeat(piece_at[kinds], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            x = self.inputs(whole[kinds], piece[sub], cnt)[at]
            logit, kept = self.forward(x, mask, keep=True)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(logit, first)
            e = np.exp(logit - top[own])
            share = e / np.add.reduceat(e, first)[own]
            pooled = np.add.reduceat(share * logit, first)
            d = ((sigmoid(pooled) - y[pick]) / len(pick))[own] * share * (1 + logit - pooled[own])
            g, dx = self.backward(x, d.astype(np.float32), kept)
            dk = scatter(len(kinds), at[mask], dx[mask])
            g["word"] = scatter(BUCKETS, whole[kinds], dk)
            g["char"] = scatter(BUCKETS, piece[sub], np.repeat(dk / cnt[:, None].astype(np.float32), cnt, axis=0))
            for k, q in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                q -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        f = np.concatenate([self.features(b, o) for _, _, b, o in slices(buffer, offsets)])
        seen = ~np.isnan(f[:, 0])
        self.floor = f[seen].min(0)
        f = f[seen]
        self.mean, self.std = f.mean(0), f.std(0) + 1e-3
        self.final, self.offset = logistic((f - self.mean) / self.std, y[seen])
        return self


def score_toxicity(docs: DataFrame, net: BiGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score) for each row of ``docs``: the probability that its whole text is toxic."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            parts = [net.score(d, o) for _, _, d, o in slices(data, offsets, 6 << 20)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=["id", "score"])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), "id long, score double").withColumnRenamed("id", id_col)


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 700, steps: int = 300) -> BiGru:
    """Learn from at most ``rows`` toxic and twice as many other labelled texts whose crc32(doc_id) mod 4 is not 2."""
    texts, y, prior = labelled_sample(docs, labels, "toxic", 4, 2, {0: 2 * rows, 1: rows})
    net = BiGru().fit(texts, y, steps)
    if 0 < y.sum() < len(y):
        net.offset += np.float32(prior)
    return net
