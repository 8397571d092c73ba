"""Hierarchical Pitman-Yor language model over the whole corpus, and its scores of every text.

Each context - the preceding token itself, or the start of a text -
is a restaurant whose customers are the tokens that follow; all restaurants share one parent,
the restaurant of the whole corpus, whose parent is uniform over the V known tokens and one unknown.
Seating is sampled by Gibbs sweeps in blocks: all customers of a dish leave a restaurant and take their tables, and the customers these
sent to the parent, with them; how many tables they take anew is drawn from its distribution given all other
seats.  That distribution is the Chinese-restaurant process's, summed over all seatings of so many tables (generalised Stirling
numbers) and weighted by the parent's probability of the dish, which grows with every customer sent.  Two things are approximate: all blocks of
a sweep are drawn at once, each given the others' seats of the sweep before (the usual way to run Gibbs in parallel), and the parent's tables of a
dish are held where they were while its restaurants are drawn.  Beyond 256 customers of one dish the number is drawn from the normal distribution at the
peak of its weights (Stirling ratios between those of 256, 512, ... 4,096 customers; beyond that scaled).  Discounts come from the counts of counts.  The predictive
probabilities of the sweeps after burn-in are averaged; a text's score is the sum of their log10.  Draws hang on hashes
of word, context and sweep, so the scores are the same for any partitioning.

*Distribution.*  Tokens are 56-bit hashes; the space of words is cut into ranges, one for every 16 MB of text but no more than
shuffle partitions (each range sends each other one row a sweep, so small tables should have few), and all contexts of a word lie together.  A block of documents sends each range its distinct (word, context) pairs with
training counts, summed before the shuffle, so a frequent word costs one entry per block and context.  The range keeps
its pairs once, and for each block the places of its pairs among them.
Ranges sample independently; a restaurant's totals are summed between sweeps by ranges of contexts, which each
range of words asks for the contexts it meets, and a later sweep replays the earlier ones from hashes and totals.
Ranges answer each block's pairs, and the block sums them by document.  No task holds a vocabulary or a
document's tokens twice, and nothing but a few sums reaches the driver.  Scratch tables go as soon as they are read.

Null and empty texts have the end token alone.  Repeated rows are scored, and counted, each.  A null
id stays null and counts as training.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import LOWER, U64, discard, materialize, mix, partitions, prefix_hash, release, slices, span_hash, text_buffers, trim, trimmed, words

BLOCK_BYTES, RANGE_BYTES, SWEEPS, BURN, THETA = 12 << 20, 16 << 20, 3, 1, 1.0
EXACT, LARGEST = 256, 4096  # customers of a dish in a restaurant up to which tables are drawn from their whole distribution; and whose weights stand for all larger numbers
END = int(mix(np.array([0xE0F], np.uint64))[0]) & ~0xFF
START = int(mix(np.array([0x57A], np.uint64))[0]) & ~0xFFFF
PAIRS, POSTINGS = 0, 1
BLOCK = "kind int, uid string, bucket int, a binary, b binary, c binary"
STATE = "bucket int, part int, uid string, a binary, b binary, c binary"
COUNTS, PLACES, WORDS_OF = -1, -2, -3  # parts of the state: a range's pairs, where a block's pairs stand among them, a block's postings


def token_keys(data, offsets):
    """(word, context, document) of all tokens: 56-bit hashes of the token and of the one before it (contexts: 48 bits of them)."""
    low = LOWER[data]
    starts, ends, docs = words(low, offsets)
    n = len(offsets) - 1
    h = span_hash(prefix_hash(low), starts, ends) & U64(0xFFFFFFFFFFFFFF00) if len(starts) else np.zeros(0, np.uint64)
    count = np.bincount(docs, minlength=n)
    total = len(h) + n
    at = np.arange(len(h)) + docs  # one end token after each document's words
    last = np.cumsum(count + 1) - 1
    token, prev, doc = np.full(total, U64(END)), np.full(total, U64(START)), np.repeat(np.arange(n), count + 1)
    token[at] = h
    prev[at + 1] = h
    prev[np.r_[0, last[:-1] + 1]] = START  # a text's first token; also the end token of an empty text
    return token, prev & ~U64(0xFFFF), doc


def changes(*columns):
    """Positions where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    np.not_equal(columns[0][1:], columns[0][:-1], out=new[1:])
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def packed(word, context, kind=None):
    """Sorted pairs in bytes: the number of words, each word's distance from the last (all first bytes, all second bytes, ...; most high ones are 0) and its number of pairs, and the contexts (hashes in six bytes, or numbers of ``kind``)."""
    first = changes(word)
    apart = np.diff(word[first] >> U64(8), prepend=U64(0))
    out = np.uint64(len(first)).tobytes() + apart.view(np.uint8).reshape(-1, 8).T.tobytes() + np.diff(np.r_[first, len(word)]).astype("<u4").tobytes()
    if kind:
        return out + context.astype(kind).tobytes()
    return out + (context >> U64(32)).astype("<u4").tobytes() + (context >> U64(16)).astype("<u2").tobytes()


def unpacked(raw, kind=None):
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    apart = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    word, arity = np.cumsum(apart, dtype=np.uint64) << U64(8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
    total, at = int(arity.sum()), 8 + 12 * n
    if kind:
        return np.repeat(word, arity), np.frombuffer(raw, kind, total, at)
    high, low = np.frombuffer(raw, "<u4", total, at), np.frombuffer(raw, "<u2", total, at + 4 * total)
    return np.repeat(word, arity), high.astype(np.uint64) << U64(32) | low.astype(np.uint64) << U64(16)


def shrunk(x):
    """Numbers in as few bytes as nearly all of them need; the others follow in eight."""
    for size in (1, 2, 4):
        top = (1 << 8 * size) - 1
        far = np.flatnonzero(x >= top)
        if len(far) * 16 <= len(x):
            break
    return np.array([size, len(far)], np.uint64).tobytes() + np.minimum(x, top).astype(f"<u{size}").tobytes() + x[far].astype(np.uint64).tobytes()


def grown(raw):
    size, far = (int(v) for v in np.frombuffer(raw, np.uint64, 2))
    n = (len(raw) - 16 - 8 * far) // size
    x = np.frombuffer(raw, f"<u{size}", n, 16).astype(np.int64)
    x[x == (1 << 8 * size) - 1] = np.frombuffer(raw, np.uint64, far, 16 + size * n).astype(np.int64)
    return x


def tight(x, below):
    """Numbers under ``below`` in as many bits as they need."""
    width = max(1, int(below - 1).bit_length())
    return b"".join(np.packbits(np.unpackbits(y.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]).tobytes() for y in np.split(x, range(1 << 18, len(x), 1 << 18)))


def loose(raw, below, n):
    width, out = max(1, int(below - 1).bit_length()), np.zeros(n, np.uint32)
    for lo in range(0, n, 1 << 18):  # a multiple of eight numbers fills whole bytes
        some = min(n - lo, 1 << 18)
        bits = np.zeros((some, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, (some * width + 7) // 8, lo * width // 8), count=some * width).reshape(some, width)
        out[lo : lo + some] = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return out


def bucket_bounds(parts: int) -> np.ndarray:
    """Least hash of each range."""
    return np.array([(i << 64) // parts & ~0xFF for i in range(parts)], np.uint64)


def emit(rows, schema):
    cols = list(zip(*rows)) or [()] * len(schema.split(","))
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def rows_of(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def blocks(docs: DataFrame, id_col: str, text_col: str, fold: int, parts: int) -> DataFrame:
    """Per block of documents: a row per range (a: distinct pairs, b: training counts), and its postings (a: ids, b: marks and the pairs' tokens, c: their documents)."""

    def run(batches):
        def close(held):
            word, context, doc = (np.concatenate(x) for x in zip(*[h[:3] for h in held]))
            ids, marks = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            held.clear()  # a worker keeps the most memory it ever took
            order = np.lexsort((context, word)).astype(np.uint32)
            word, context, doc = word[order], context[order], doc[order]
            begin = changes(word, context)
            size = np.diff(np.r_[begin, len(word)])
            word, context = word[begin], context[begin]
            train = np.add.reduceat((marks[doc] & 1 == 0).astype(np.int64), begin)
            cut = np.r_[np.searchsorted(word, bucket_bounds(parts)), len(word)]
            uid = f"{TaskContext.get().partitionId()}-{next(number)}"  # the same if the task runs again
            rows = [(POSTINGS, uid, -1, ids.astype("<i8").tobytes(), marks.tobytes() + shrunk(size), tight(doc, len(ids)))]
            rows += [(PAIRS, uid, i, packed(word[s:e], context[s:e]), shrunk(train[s:e]), None) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if s < e]
            return emit(rows, BLOCK)

        held, seen, size, number = [], 0, 0, count()
        for b in batches:
            data, offsets = text_buffers(b.column(2))
            ids, marks = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy().astype(np.uint8)
            for lo, hi, d, o in slices(data, offsets):
                word, context, doc = token_keys(d, o)
                held.append((word, context, (doc + seen).astype(np.uint32), ids[lo:hi], marks[lo:hi]))
                seen, size = seen + hi - lo, size + len(d)
                if size >= BLOCK_BYTES or seen >= 60_000:
                    yield close(held)
                    held, seen, size = [], 0, 0
                    trim()
        if held:
            yield close(held)
        trim()

    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0, F.lit(False)).cast("int")
    marks = held_out + 2 * F.col(id_col).isNull().cast("int")  # bit 0: held out, bit 1: no id
    return docs.select(F.col(id_col).cast("long"), marks, F.col(text_col)).toDF("id", "marks", "text").mapInArrow(trimmed(run), BLOCK)


def merged(batches):
    """State of each range met in a partition: COUNTS (a: all pairs, contexts by number; b: training counts; c: the contexts), and PLACES of each block; postings as they are."""
    held: dict[int, list] = {}
    for kind, uid, bucket, a, b, c in rows_of(batches):
        if kind == POSTINGS:
            yield emit([(bucket, WORDS_OF, uid, a, b, c)], STATE)
        else:
            held.setdefault(bucket, []).append((uid, a, b))
    for bucket in sorted(held):
        trim()
        mine = held.pop(bucket)
        pairs, n = [unpacked(a) for _, a, _ in mine], np.concatenate([grown(x) for _, _, x in mine])
        mine = [uid for uid, _, _ in mine]
        word, context = (np.concatenate(x) for x in zip(*pairs))
        sizes = np.cumsum([len(w) for w, _ in pairs])[:-1]
        del pairs
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        begin = changes(word, context)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        n = np.add.reduceat(n[order], begin)
        word, context = word[begin], context[begin]
        asked, number = np.unique(context, return_inverse=True)
        yield emit([(bucket, COUNTS, None, packed(word, number, "<u4"), shrunk(n), asked.tobytes())], STATE)
        del word, context, n, number, asked, order
        for uid, x in zip(mine, np.split(place, sizes)):
            yield emit([(bucket, PLACES, uid, shrunk(np.diff(x, prepend=-1)), None, None)], STATE)
    trim()


def drawn(key, salt, step):
    """A number in [0, 1) for each key."""
    return (mix(key + U64((salt * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) & (1 << 64) - 1)) >> U64(11)).astype(np.float64) / 2.0**53


@cache
def stirling(d):
    """Row c <= EXACT, and rows of doubled c up to LARGEST: log(S(c, t + 1) / S(c, t)) for t = 1 to c - 1, S(c, t) being the weight of all seatings of c customers at t tables under discount d."""
    log, t = np.full(LARGEST + 2, -np.inf), np.arange(LARGEST + 2)
    log[1] = 0
    rows = {1: log[:0]}
    for n in range(1, LARGEST):  # the same with one customer more
        m = n + 3
        log[1:m] = np.logaddexp(log[: m - 1], log[1:m] + np.log(np.maximum(n - d * t[1:m], 1e-300)))
        if n < EXACT or (n + 1) % EXACT == 0 and ((n + 1) // EXACT).bit_count() == 1:
            rows[n + 1] = np.diff(log[1 : n + 2])
    return rows


def seat(c, d, mass, key, salt):
    """Tables of the c customers (each >= 1) of one dish; mass(i, t): that of a new table for dish i after t of its tables; draws hang on ``key``."""
    t, steps = np.ones(len(c)), stirling(d)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    for alike in np.split(few, np.flatnonzero(np.diff(c[few])) + 1) if len(few) else ():
        n = int(c[alike[0]])
        tables = np.arange(1, n)
        for i in np.split(alike, range(max(1, (1 << 18) // n), len(alike), max(1, (1 << 18) // n))):
            w = np.zeros((len(i), n))  # logarithms of the weights of 1 to n tables
            np.cumsum(np.log(mass(i[:, None], tables)) + steps[n], axis=1, out=w[:, 1:])
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[i] += (w[:, :-1] <= (drawn(key[i], salt, 0) * w[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        t[many] = peaks(c[many].astype(np.float64), d, lambda x: mass(many, x), steps, drawn(key[many], salt, 0), drawn(key[many], salt, 1))
    return t


def peaks(c, d, mass, steps, u, v):
    """Numbers of tables drawn from the normal distribution at the peak of their weights.

    Step ratios of c customers lie between those of the next smaller and larger row, at equal log t / log c.  Beyond
    LARGEST tables grow as c ** d: t tables stand where t * (LARGEST / c) ** d of its row do, and a step's ratio goes as one over the tables.
    """
    near = np.minimum(c, LARGEST)
    scale, whole = (near / c) ** d, np.log(near)
    below = np.minimum(np.floor(np.log2(near / EXACT)).astype(int), (LARGEST // EXACT).bit_length() - 2)
    share = np.log2(near / EXACT) - below

    def slope(t):
        at, out = np.log(np.maximum(t * scale, 1)) / whole, np.zeros(len(t))
        for k in np.unique(below):
            mine = below == k
            for n, part in ((EXACT << k, 1 - share[mine]), (EXACT << k + 1, share[mine])):
                tables = np.arange(1, n)
                out[mine] += part * np.interp(at[mine], np.log(tables) / np.log(n), steps[n] + np.log(tables))
        return out - at * whole + np.log(scale) + np.log(mass(t))

    low, high = np.ones(len(c)), (near - 1) / scale
    for _ in range(32):  # weights rise up to the peak and fall beyond it
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    before, after = np.maximum(low * 0.95, 1), np.maximum(low * 1.05, low + 0.5)
    spread = np.sqrt(np.minimum((after - before) / np.maximum(slope(before) - slope(after), 1e-300), low + 1))
    normal = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
    return np.clip(np.round(low + 0.5 + spread * normal), 1, c)


class Restaurants:
    """One range's dishes, and the seatings that known totals lead to.

    Sorted pairs of word and context (its number among ``contexts``) with training counts; pairs without are only asked for.
    """

    def __init__(self, word, number, counts, contexts, shared):
        begin = changes(word)
        self.words, self.of_all, self.number, self.shared = word[begin], np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(word)])), number, shared
        self.at = np.flatnonzero(counts > 0)
        self.of, self.context, self.counts = self.of_all[self.at], number[self.at], counts[self.at]
        self.pair = mix(word[self.at] + mix(contexts[self.context] + U64(1)))

    def summed(self, x):
        return np.bincount(self.of, x, len(self.words))

    def root(self, cw, tw, c, r):
        """The parent's probability of each word, given its customers and tables and those of all words."""
        s = self.shared
        return (cw - s["d0"] * tw + (THETA + s["d0"] * r) / (s["V"] + 1)) / (THETA + c)

    def sweeps(self, totals):
        """After each sweep: tables per pair, customers and tables per word in the parent.

        totals[i]: the corpus's (tables per context, parent's customers, parent's tables) before sweep i.
        """
        s = self.shared
        d, d0, base = s["d"], s["d0"], 1 / (s["V"] + 1)
        t, counts = np.ones(len(self.at)), self.counts
        cw = self.summed(t)
        tw = (cw > 0).astype(np.float64)
        some = np.flatnonzero(cw > 0)
        for i, (tables, c, r) in enumerate(totals):
            others, sent, top, from_above, all_ = tables[self.context] - t, cw[self.of] - t, tw[self.of], (THETA + d0 * r) * base, THETA + c - t

            def in_context(k, n):
                """The dish's other customers in the parent and the n that its tables have sent stay at no more tables than there are customers."""
                there = sent[k] + n
                return (THETA + d * (others[k] + n)) * (there - d0 * np.minimum(top[k], there) + from_above) / (all_[k] + n)

            t = seat(counts, d, in_context, self.pair, 2 * (s["seed"] + i))
            cw, rest = self.summed(t), r - tw[some]
            tw = np.zeros(len(self.words))
            tw[some] = seat(cw[some].astype(np.int64), d0, lambda k, n, rest=rest: (THETA + d0 * (rest[k] + n)) * base, self.words[some], 2 * (s["seed"] + i) + 1)
            yield t, cw, tw

    def averaged(self, totals, customers):
        """Mean predictive probability of all pairs over the sweeps after burn-in, and training counts of the words."""
        s, mean = self.shared, np.zeros(len(self.of_all))
        for i, (t, cw, tw) in enumerate(self.sweeps(totals[:-1])):
            if i < BURN:
                continue
            tables, c, r = totals[i + 1]
            own = np.zeros(len(mean))
            own[self.at] = self.counts - s["d"] * t
            mean += (own + (THETA + s["d"] * tables[self.number]) * self.root(cw, tw, c, r)[self.of_all]) / (THETA + customers[self.number])
        return mean / (SWEEPS - BURN), self.summed(self.counts).astype(np.int64)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, seed: int = 17) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod ``fold`` is 0 are held out; the model learns from all others.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(partitions(spark), max(1, -(-size // RANGE_BYTES)))
    to = F.when(F.col("kind") == PAIRS, F.col("bucket")).otherwise(F.pmod(F.hash("uid"), F.lit(parts)))
    state = materialize(blocks(docs, id_col, text_col, fold, parts).withColumn("_to", to).repartitionById(parts, F.col("_to")).drop("_to").mapInArrow(trimmed(merged), STATE), "state", by="part")
    release(spark)
    known = [state.where(F.col("part") == COUNTS)]
    shared: dict = {"seed": seed}

    def ranges(rows):
        """(bucket, contexts, restaurants, totals of the contexts by sweep, places of blocks) of each range in a partition."""
        held: dict[int, tuple] = {}
        for bucket, part, uid, a, b, c in rows:
            mine = held.setdefault(bucket, ({}, []))
            if part == PLACES:
                mine[1].append((uid, a))
            else:
                mine[0][part] = (a, b, c)
        for bucket in sorted(held):
            trim()
            mine, places = held.pop(bucket)
            a, b, c = mine.pop(COUNTS)
            contexts = np.frombuffer(c, np.uint64)
            word, number = unpacked(a, "<u4")
            sums = [grown(mine[i][0]).astype(np.float64) for i in sorted(mine)]
            yield bucket, contexts, Restaurants(word, number.astype(np.int64), grown(b), contexts, shared), sums, places

    def together():
        """The state with all totals so far, each range in one partition."""
        out = known[0]
        for k in known[1:]:
            out = out.unionByName(k)
        return out.repartitionById(parts, F.col("bucket"))

    def exchange(measure, ranged):
        """Totals over all ranges of some numbers for each pair, by context, sent back to every range that asks for the context.

        ``measure`` gives the numbers and what the driver sums up; returns the sums over all ranges.
        """

        def ask(batches):
            for bucket, contexts, x, sums, _ in ranges(rows_of(batches)):
                each, others = measure(x, sums)
                yield emit([(bucket, -1, None, np.array(others, np.float64).tobytes(), None, None)], STATE)
                v = np.stack([np.bincount(x.context, y, len(contexts)).astype(np.int64) for y in each])
                cut = np.r_[np.searchsorted(contexts, bucket_bounds(parts)), len(contexts)]
                for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])):
                    if s < e:
                        yield emit([(bucket, i, None, (contexts[s:e] >> U64(32)).astype("<u4").tobytes() + (contexts[s:e] >> U64(16)).astype("<u2").tobytes(), shrunk(v[:, s:e].ravel()), None)], STATE)

        def add(batches):
            held: dict[int, list] = {}
            for bucket, part, _, a, b, _ in rows_of(batches):
                n = len(a) // 6
                context = np.frombuffer(a, "<u4", n).astype(np.uint64) << U64(16) | np.frombuffer(a, "<u2", n, 4 * n).astype(np.uint64)
                held.setdefault(part, []).append((bucket, context, grown(b).reshape(-1, n)))
            for part in sorted(held):
                asks = held.pop(part)
                kinds, at = np.unique(np.concatenate([a for _, a, _ in asks]), return_inverse=True)
                v = np.concatenate([v for *_, v in asks], axis=1)
                sums = np.stack([np.bincount(at, y, len(kinds)) for y in v]).astype(np.int64)[:, at]
                for (bucket, _, _), x in zip(asks, np.split(sums, np.cumsum([len(a) for _, a, _ in asks])[:-1], axis=1)):
                    yield emit([(bucket, part, None, shrunk(x.ravel()), len(x).to_bytes(1), None)], STATE)

        def join(batches, first=0 if len(known) == 1 else len(known)):  # the first exchange is of two numbers
            held: dict[int, dict] = {}
            for bucket, part, _, a, b, _ in rows_of(batches):
                held.setdefault(bucket, {})[part] = grown(a).reshape(b[0], -1)
            for bucket in sorted(held):
                mine = held.pop(bucket)
                for k, x in enumerate(np.concatenate([mine[i] for i in sorted(mine)], axis=1)):
                    yield emit([(bucket, first + k, None, shrunk(x), None, None)], STATE)

        asks = materialize(ranged.mapInArrow(trimmed(ask), STATE), "asks")
        others = [np.frombuffer(r["a"], np.float64) for r in asks.where("part = -1").select("a").collect()]  # a row a range
        replies = asks.where("part >= 0").repartitionById(parts, F.col("part")).mapInArrow(trimmed(add), STATE)
        known.append(materialize(replies.repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(join), STATE), "totals"))
        discard(asks)
        release(spark)
        return np.sum(others, axis=0) if others else np.zeros(8)

    def shape(x, sums):
        arity = np.bincount(x.of, minlength=len(x.words))
        some = [x.counts.sum(), (arity > 0).sum(), len(x.at), (x.counts == 1).sum(), (x.counts == 2).sum(), (arity == 1).sum(), (arity == 2).sum()]
        return (x.counts, np.ones(len(x.at))), some

    found = exchange(shape, known[0])  # customers and first tables of each context
    discount = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))
    shared |= {"N": int(found[0]), "V": int(found[1]), "d": discount(found[3], found[4]), "d0": discount(found[5], found[6])}
    parent = [(found[2], found[1])]  # customers and tables of the parent before each sweep

    def whole(sums, parent):
        return [(t, c, r) for t, (c, r) in zip(sums[1:], parent)]

    for _ in range(SWEEPS):

        def last(x, sums, parent=tuple(parent)):
            for seated in x.sweeps(whole(sums, parent)):
                pass
            t, cw, tw = seated
            return (t,), [cw.sum(), tw.sum()]

        parent.append(tuple(exchange(last, together())[:2]))

    def answer(batches):
        for bucket, _, x, sums, places in ranges(rows_of(batches)):
            p, total = x.averaged(whole(sums, parent), sums[0])
            p = np.log10(p).astype("<f4")
            for uid, at in places:
                at = np.cumsum(grown(at)) - 1
                of = x.of_all[at]
                begin = changes(of)
                words_ = shrunk(total[of[begin]])
                yield emit([(POSTINGS, uid, bucket, p[at].tobytes(), words_, shrunk(np.diff(np.r_[begin, len(of)])))], BLOCK)

    known.append(state.where(F.col("part") == PLACES))
    answers = together().mapInArrow(trimmed(answer), BLOCK)

    def finish(batches):
        def close(rows):
            _, ids, sizes, doc = rows[0]
            ids = np.frombuffer(ids, "<i8")
            n = len(ids)
            marks, size = np.frombuffer(sizes[:n], np.uint8), grown(sizes[n:])
            doc = loose(doc, n, int(size.sum()))
            log = np.concatenate([np.frombuffer(a, "<f4") for _, a, _, _ in rows[1:]]).astype(np.float64)
            total = np.concatenate([np.repeat(grown(b), grown(c)) for _, _, b, c in rows[1:]]).astype(np.float64)
            base = np.log10((total + 0.1) / (shared["N"] + 0.1 * (shared["V"] + 1)))
            sums = [np.bincount(doc, np.repeat(x, size), n) for x in (np.ones(len(size)), total > 0, base, log)]
            cols = [pa.array(ids, mask=marks & 2 > 0), pa.array(marks & 1 > 0), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, shared["N"], np.int64)), pa.array(sums[2]), pa.array(sums[3])]
            return pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        rows, key = [], None
        for uid, bucket, x, y, z in rows_of(batches):
            if uid != key and rows:
                yield close(rows)
                rows = []
            key = uid
            rows.append((bucket, x, y, z))
        if rows:
            yield close(rows)

    answers = materialize(answers.select("uid", "bucket", "a", "b", "c"), "answers")
    postings = state.where(F.col("part") == WORDS_OF).select("uid", "bucket", "a", "b", "c")
    discard(*known[1:-1])
    for done in (COUNTS, PLACES):  # the postings alone are still needed
        discard(state, part=f"part={done}")
    release(spark)
    both = postings.unionByName(answers).repartition(parts, "uid").sortWithinPartitions("uid", "bucket")
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(trimmed(finish), schema).withColumnRenamed("id", id_col)
