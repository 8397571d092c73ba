"""Exact substring deduplication over sorted suffixes of all texts.

Removes each byte covered by a ``LENGTH``-byte string that also starts earlier (in a document with a
smaller id, or earlier in the same one); matches never cross documents.

*Suffixes.*  Sorting a suffix per byte would move a hundred times the text.  Instead suffixes start at
anchors: in every window of ``LENGTH`` bytes the position whose ``LEAD`` bytes have the least hash (the
leftmost of equals).  The choice depends on the window's bytes alone, so equal windows choose
anchors at equal places, and equal windows are found among suffixes with equal first ``LEAD`` bytes:
nothing is missed.  An anchor answers for the run of windows that chose it.

*Sorting.*  Splitters sampled from the suffixes' leading bytes cut them into ranges of like weight.  Each
range is sorted by a multikey quicksort on eight-byte words: suffixes are parted by a pivot into less, equal and greater in
one word, the equal ones go on to the next word, through the leading bytes and then the hash of the run's whole text,
document and place.  Neighbours with equal text are copies: all but the first are covered; that is
settled before the shuffle within a block of documents and after it in the range.  Leads
that the sample shows to be common are dealt by the text that follows, so that a passage which a third
of all documents share doesn't meet in one range.

*Across boundaries.*  Ranges are cut between different leads, so equal windows lie in one range but for common leads.
Where one lead is followed by different texts, and for common leads, runs may overlap in part.  Their
first copies are compared window by window: windows are dealt by 64-bit hash over all ranges, and
all but the first of equal windows are covered.

Null texts are empty.  Rows that share an id are documents of their own if their texts differ, in the order of a hash of the
text; rows equal in id and text are one document, and each is returned with its result.  Rows without an id come before all
others, in the order of a hash of the text (ids under -2**62 are an error).  Texts under ``LENGTH`` bytes stay whole.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import U64, discard, materialize, mix, partitions, powers, prefix_hash, slices, span_hash, text_buffers, trimmed

LENGTH, LEAD, BLOCK_BYTES, SAMPLED = 100, 32, 12 << 20, 256
WORDS = LEAD // 8
# leading bytes as numbers, text, document (id and tag), first window, windows
RUN = np.dtype([("k", "<u8", (WORDS,)), ("r", "<u8"), ("d", "<i8"), ("t", "<u4"), ("s", "<u4"), ("n", "u1")])
SPAN = np.dtype([("d", "<i8"), ("t", "<u4"), ("s", "<u4"), ("e", "<u4")])
WINDOW = np.dtype([("w", "<u8"), ("d", "<i8"), ("t", "<u4"), ("s", "<u4")])
NO_ID = -(2**62)
ROW = "kind int, bucket int, rows binary"


def window_starts(offsets):
    """Starts of all windows that lie in one document."""
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def anchors(data, offsets):
    """(leading bytes, text hash, document, first window, windows) of the runs of windows with one anchor."""
    starts = window_starts(offsets)
    z = np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((0, WORDS), np.uint64), z.astype(np.uint64), z, z, z
    prefix = prefix_hash(data)
    _, down = powers(len(prefix))
    n = len(data) - LEAD + 1
    lead = mix((prefix[LEAD:] - prefix[:-LEAD]) * down[:n])
    bits = U64(max(1, n.bit_length()))
    best = (lead >> bits << bits) | np.arange(n, dtype=np.uint64)
    width, size = LENGTH - LEAD + 1, 1
    while 2 * size <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    chosen = (best[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, p = starts[new], chosen[new]
    count = np.diff(np.r_[new, len(starts)])
    text = mix(span_hash(prefix, first, first + count - 1 + LENGTH) + (p - first).astype(np.uint64))
    head = np.zeros((len(p), WORDS), np.uint64)
    for j in range(LEAD):
        head[:, j // 8] = head[:, j // 8] << U64(8) | data[p + j]
    return head, text, np.searchsorted(offsets, first, "right") - 1, first, count


def multikey_quicksort(keys, small: int = 1 << 12):
    """Order of rows of words: a pivot parts them in one word, equal ones go on to the next; few rows are sorted at once."""
    order, todo = np.arange(len(keys)), [(0, len(keys), 0)]
    while todo:
        lo, hi, at = todo.pop()
        part = order[lo:hi]
        if hi - lo <= small or at == keys.shape[1] - 1:
            order[lo:hi] = part[np.lexsort(keys[part, at:].T[::-1])]
            continue
        x = keys[part, at]
        seen = np.sort(x[:: max(1, len(x) // 99)])
        pivot = seen[len(seen) // 2]
        less, more = x < pivot, x > pivot
        equal = part[~less & ~more]
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], equal, part[more]])
        todo += [(lo, a, at), (a, b, at + 1), (b, hi, at)]
    return order


def repeats(rows, same):
    """Of sorted rows, those that begin a group (``same``: equal to the row before), and the later ones of each.

    Rows that repeat the first one's document and place are not later.
    """
    if not len(rows):
        return same, same
    begin = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    other = np.logical_or.reduce([rows[n] != rows[n][begin] for n in ("d", "t", "s")])
    return ~same, same & other


def firsts(rows, name):
    """Positions of the first row (by document and place) of each kind, and of all others."""
    order = np.lexsort((rows["s"], rows["t"], rows["d"], rows[name]))
    rows = rows[order]
    first, later = repeats(rows, np.r_[False, rows[name][1:] == rows[name][:-1]] if len(rows) else np.zeros(0, bool))
    return order[first], order[later]


def spans_of(rows, count):
    out = np.empty(len(rows), SPAN)
    out["d"], out["t"], out["s"], out["e"] = rows["d"], rows["t"], rows["s"], rows["s"].astype(np.int64) + count - 1 + LENGTH
    return out


def new_document(spans):
    return np.r_[True, (spans["d"][1:] != spans["d"][:-1]) | (spans["t"][1:] != spans["t"][:-1])]


def merge(spans):
    """Union of the byte ranges of each document, sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["s"], spans["t"], spans["d"]))]
    rank = np.cumsum(new_document(spans)).astype(np.int64) << 33
    s, e = rank + spans["s"], rank + spans["e"]
    reach = np.maximum.accumulate(e)
    new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
    out = spans[new].copy()
    out["e"] = (reach[np.r_[new[1:] - 1, len(spans) - 1]] - rank[new]).astype(np.uint32)
    return out


def batch_of(rows):
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], names=["kind", "bucket", "rows"])


def dealt(kind, rows, bucket, parts):
    """One output row per bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(parts + 1))
    return [(kind, i, rows[order[cut[i] : cut[i + 1]]].tobytes()) for i in range(parts) if cut[i] < cut[i + 1]]


def by_document(kind, spans, parts):
    return dealt(kind, spans, (mix(spans["d"].astype(np.int64).view(np.uint64) + spans["t"]) % U64(parts)).astype(np.int64), parts)


def gather(batches):
    """{kind: {bucket: rows}} of a partition, as lists of bytes."""
    held: dict[int, dict[int, list]] = {}
    for b in batches:
        for kind, bucket, rows in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault(kind, {}).setdefault(bucket, []).append(rows)
    return held


def plan(docs: DataFrame, parts: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the suffixes' leading bytes, and common leads, from at most ``SAMPLED`` suffixes of each of about ``sample_rows`` texts chosen by a hash."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for _, _, d, o in slices(data, offsets):
                k, _, doc, _, _ = anchors(d, o)
                first = np.searchsorted(doc, np.arange(len(o)))
                step = np.maximum(1, -(-np.diff(first) // SAMPLED))
                pick = (np.arange(len(doc)) - first[doc]) % step[doc] == 0 if len(doc) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array([k[pick].tobytes()], pa.binary()), pa.array([len(o) - 1], pa.int64())], names=["k", "n"])

    every = max(1, docs.count() // sample_rows)
    rows = docs.where(F.pmod(F.xxhash64("id", "tag"), F.lit(every)) == 0).select("text").mapInArrow(trimmed(run), "k binary, n long").collect()
    lead = np.frombuffer(b"".join(r["k"] for r in rows), np.uint64).reshape(-1, WORDS)
    if not len(lead):
        return lead, np.zeros(0, np.uint64)
    lead = lead[multikey_quicksort(lead)]
    kinds, times = np.unique(lead_hash(lead), return_counts=True)
    return lead[np.arange(1, parts) * len(lead) // parts], kinds[times >= max(4, sum(r["n"] for r in rows) // 100)]


def lead_hash(k):
    out = np.zeros(len(k), np.uint64)
    for j in range(WORDS):
        out = mix(out + k[:, j] + U64(j))
    return out


def range_of(k, splitters):
    """The range of each lead: how many splitters are not greater, word by word."""
    out = np.searchsorted(splitters[:, 0], k[:, 0], "left")
    tied = np.flatnonzero(np.searchsorted(splitters[:, 0], k[:, 0], "right") > out)
    for j in np.flatnonzero(np.isin(splitters[:, 0], k[tied, 0])):  # splitters whose first word some leads share
        at = tied[k[tied, 0] == splitters[j, 0]]
        least = np.ones(len(at), bool)
        for w in reversed(range(1, WORDS)):
            least = np.where(k[at, w] == splitters[j, w], least, k[at, w] > splitters[j, w])
        out[at] += least
    return out


def covered_runs(docs: DataFrame, parts: int, splitters, common) -> DataFrame:
    """Kind 1: covered byte ranges; kind 2: windows that need a comparison one by one; both by document bucket."""

    def split(batches):
        def emit(held):
            rows = np.concatenate(held)
            keep, later = firsts(rows, "r")  # the text's hash has its lead in it
            out = by_document(1, merge(spans_of(rows[later], rows["n"][later].astype(np.int64))), parts)
            rows = rows[keep]
            hot = np.isin(lead_hash(rows["k"]), common)
            bucket = (rows["r"] % U64(parts)).astype(np.int64)
            bucket[~hot] = range_of(rows["k"][~hot], splitters)
            return batch_of(out + dealt(0, rows, bucket, parts))

        held, size = [], 0
        for b in batches:
            data, offsets = text_buffers(b.column(2))
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, d, o in slices(data, offsets):
                k, r, doc, s, n = anchors(d, o)
                rows = np.empty(len(k), RUN)
                rows["k"], rows["r"], rows["d"], rows["t"], rows["s"], rows["n"] = k, r, ids[lo + doc], tags[lo + doc], s - o[doc], n
                held.append(rows)
                size += len(d)
                if size >= BLOCK_BYTES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def settle(batches):
        held = gather(batches)
        for kind in (1,):
            for bucket, rows in held.pop(kind, {}).items():
                yield batch_of([(kind, bucket, b"".join(rows))])
        for bucket in sorted(held.get(0, {})):
            rows = np.frombuffer(b"".join(held[0].pop(bucket)), RUN)
            place = np.stack([rows["r"], rows["d"].astype(np.int64).view(np.uint64) ^ U64(1 << 63), rows["t"].astype(np.uint64) << U64(32) | rows["s"]], axis=1)
            rows = rows[multikey_quicksort(np.concatenate([rows["k"], place], axis=1))]
            lead = (rows["k"][1:] == rows["k"][:-1]).all(1)
            keep, later = repeats(rows, np.r_[False, lead & (rows["r"][1:] == rows["r"][:-1])])
            out = by_document(1, merge(spans_of(rows[later], rows["n"][later].astype(np.int64))), parts)
            rows = rows[keep]
            many = np.zeros(len(rows), bool)
            twin = (rows["k"][1:] == rows["k"][:-1]).all(1)
            many[1:] |= twin
            many[:-1] |= twin
            many |= np.isin(lead_hash(rows["k"]), common)
            yield batch_of(out + by_document(2, merge(spans_of(rows[many], rows["n"][many].astype(np.int64))), parts))

    moved = docs.mapInArrow(trimmed(split), ROW).withColumn("to", F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.pmod(F.hash("bucket", F.spark_partition_id()), F.lit(parts))))
    return moved.repartition(parts, "to").select("kind", "bucket", "rows").mapInArrow(trimmed(settle), ROW)


def per_document(spans: DataFrame, parts: int) -> DataFrame:
    """(id, spans): the merged byte ranges of each document."""

    def run(batches):
        held = gather(batches)
        for bucket in sorted({b for x in held.values() for b in x}):
            rows = merge(np.frombuffer(b"".join(r for x in held.values() for r in x.pop(bucket, [])), SPAN))
            first = np.flatnonzero(new_document(rows)) if len(rows) else np.zeros(0, np.int64)
            ends = np.r_[first[1:], len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["d"][first]), pa.array(rows["t"][first].astype(np.int64)), pa.array([rows[s:e].tobytes() for s, e in zip(first, ends)], pa.binary())], names=["doc", "of", "spans"])

    return spans.repartition(parts, "bucket").mapInArrow(trimmed(run), "doc long, of long, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    """``docs`` joined to their ranges; the ranges are broadcast only while they take ``broadcast_bytes`` at most."""
    size = spans.agg(F.sum(F.octet_length("spans") + 24)).first()[0] or 0
    return docs.join(F.broadcast(spans) if size <= broadcast_bytes else spans, (F.col("id") == F.col("doc")) & (F.col("tag") == F.col("of")), how).select("id", "tag", "text", "spans")


def covered_windows(docs: DataFrame, parts: int) -> DataFrame:
    """Kind 1: covered byte ranges among the windows inside the given ranges, by document bucket."""

    def split(batches):
        def emit(held):
            rows = np.concatenate(held)
            keep, later = firsts(rows, "w")
            out = by_document(1, merge(spans_of(rows[later], 1)), parts)
            rows = rows[keep]
            return batch_of(out + dealt(0, rows, (rows["w"] >> U64(32)).astype(np.int64) % parts, parts))

        held, size = [], 0
        for b in batches:
            data, offsets = text_buffers(b.column(2))
            ids, tags, spans = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for lo, hi, d, o in slices(data, offsets):
                prefix = prefix_hash(d)
                for i in range(lo, hi):
                    x = np.frombuffer(spans[i].as_py(), SPAN)
                    n = x["e"].astype(np.int64) - x["s"] - LENGTH + 1
                    s = np.repeat(x["s"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    rows = np.empty(len(s), WINDOW)
                    rows["w"], rows["d"], rows["t"], rows["s"] = span_hash(prefix, o[i - lo] + s, o[i - lo] + s + LENGTH), ids[i], tags[i], s
                    held.append(rows)
                    size += len(rows)
                if size >= 1 << 20:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def settle(batches):
        held = gather(batches)
        for bucket, rows in held.pop(1, {}).items():
            yield batch_of([(1, bucket, b"".join(rows))])
        for bucket in sorted(held.get(0, {})):
            rows = np.frombuffer(b"".join(held[0].pop(bucket)), WINDOW)
            _, later = firsts(rows, "w")
            yield batch_of(by_document(1, merge(spans_of(rows[later], 1)), parts))

    moved = docs.mapInArrow(trimmed(split), ROW).withColumn("to", F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.pmod(F.hash("bucket", F.spark_partition_id()), F.lit(parts))))
    return moved.repartition(parts, "to").select("kind", "bucket", "rows").mapInArrow(trimmed(settle), ROW)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, tag, text, spans) of every row; spans: the byte ranges to remove, null for none; ids as in ``plain_rows``."""
    parts = partitions(docs.sparkSession)
    plain = plain_rows(docs, id_col, text_col)
    splitters, common = plan(plain, parts, sample_rows)
    found = materialize(covered_runs(plain, parts, splitters, common), "runs")
    open_ = materialize(per_document(found.where("kind = 2"), parts), "open")
    more = materialize(covered_windows(with_spans(plain, open_, "inner", broadcast_bytes), parts), "windows")
    spans = materialize(per_document(found.where("kind = 1").unionByName(more), parts), "spans")
    discard(found, open_, more)
    return with_spans(plain, spans, "left", broadcast_bytes)


def plain_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): tag has 32 bits of the text's hash; rows without an id get one under all others from it."""
    hash_ = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.col(id_col).cast("long")
    sound = F.when(key < NO_ID, F.raise_error(F.lit("ids under -2**62 are reserved")).cast("long")).otherwise(key)
    return docs.select(F.coalesce(sound, F.lit(-(2**63)) + hash_.bitwiseAND(F.lit(2**62 - 1))).alias("id"), hash_.bitwiseAND(F.lit(2**32 - 1)).alias("tag"), F.col(text_col).alias("text"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the bytes that are left of every row's text."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2)):
                raw, x = (text.as_py() or "").encode(), np.frombuffer(spans.as_py() or b"", SPAN)
                cuts = [0, *(int(v) for s in x for v in (s["s"], s["e"])), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(x), kept))
            cols = list(zip(*out)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = removed_spans(docs, id_col, text_col).select(F.when(F.col("id") >= NO_ID, F.col("id")).alias("id"), "text", "spans")
    return done.mapInArrow(trimmed(run), "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
