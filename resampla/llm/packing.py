"""Best-fit packing of token sequences into bins of a fixed capacity, bulk-synchronously.

Waiting documents and open gaps are rows of distributed tables.  A round range-sorts both by size, descending and
gaps before documents of their size, into ranges of bounded rows (a size that many rows share is spread over ranges of its
own).  Each range is swept from large to small: a document takes its successor, the smallest gap before it
that no larger document took, so conflicts over a gap are settled by rank.  What a sweep leaves over is carried across
ranges: from the numbers of documents and gaps left in each range (two per range reach the driver) follows which run of
ranks of one range's documents meets which run of another's gaps, and the runs meet in a second exchange.  Gaps
are updated and the next round begins.  A gap takes one document a round.

Documents enter by size: first those of over an eighth of the capacity, then over a 32nd, then the rest, so that
small ones fill what large ones leave.  Sequences are opened when a document fits no gap: at first as many as the sum of
all lengths needs (and one for each document over half the capacity), each by one of the longest documents; later
by documents that fit nowhere, a few together.  Where tiny documents prevail, seven in eight of them
are joined into bundles first, so that the number of rounds has a bound.  The counts of each size (at most two per token of
capacity) are all else that the driver sees.

Null texts are empty; an empty text still has its end token.  Ties are ordered by row.  Repeated
rows and null ids are packed each on its own.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import materialize, mix, partitions, small_batches, trimmed

CAPACITY = 2048
_HARD, _RUN = re.compile(r"\s \s"), re.compile(r"\s\s")
_state: dict = {}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Pieces are merged by rank: in a byte-level vocabulary the rank of a merge is the id it makes, so that gives the
    same ids as the vocabulary's own library, faster (a test holds them together).  Texts without runs of white space need no
    look-ahead, which is slow.  Texts with runs of white space around a space, and those that spell out a special token,
    which gets its own id, are left to the library.  Nothing is remembered: most spellings of a large corpus are seldom met again.
    """

    # The pre-tokeniser's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        if set(pre_tokenizers.ByteLevel.alphabet()) != set(letter):
            raise ValueError("not the byte-level alphabet")
        ranks = {bytes(letter[c] for c in word): i for word, i in self.model.get_vocab(with_added_tokens=False).items() if all(c in letter for c in word)}
        self.added = sorted(v.content for v in self.model.get_added_tokens_decoder().values())
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in self.added}
        self.ranked = tiktoken.Encoding("ranked", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=self.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})

    def raw(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [_RUN.search(t) is not None for t in texts]
        hard = [(r and ("  " in t or _HARD.search(t) is not None)) or any(x in t for x in self.added) for t, r in zip(texts, runs)]
        whole = iter(self.raw([t for t, h in zip(texts, hard) if h]))
        return [next(whole) if h else np.array((self.ranked if r else self.single).encode_ordinary(t), "<u4").tobytes() for t, r, h in zip(texts, runs, hard)]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32).  Only texts of more ids than ``capacity`` are cut; their first piece takes the remainder."""

    def run(batches):
        key = ("encoder", tokenizer_path)
        if key not in _state:
            _state[key] = Encoder(tokenizer_path)
        encoder, end = _state[key], np.array([end_id], "<u4").tobytes()
        for b in batches:
            out, keys, lo = [], b.column(0).to_pylist(), 0
            column = pc.fill_null(b.column(1), "")
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            while lo < len(keys):  # about a MB of whole texts at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                for doc, ids in zip(keys[lo:hi], encoder.encode(column[lo:hi].to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    start, k = 0, 0
                    while start < n:
                        stop = start + (n - start) % capacity if k == 0 and n % capacity else start + capacity
                        out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, k = stop, k + 1
                lo = hi
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- rounds

ITEM = np.dtype([("n", "<u4"), ("u", "<i8")])  # a document's length and row, or a gap and its bin
PLACED = np.dtype([("u", "<i8"), ("bin", "<i8"), ("at", "<u4")])
RANGE_ROWS, TINY = 1 << 16, 16  # least rows of a range; documents of a capacity / TINY and less are tiny
PUT, DOC, GAP, DOC_LEFT, GAP_LEFT, MEMBER, DOCS_OF, GAPS_OF = range(8)
STATE = "kind int, range int, n long, rows binary"


def batch_of(rows, gone=(), count=False):
    """A row for each run of items; with ``count`` also, for what waits, its numbers by size (DOCS_OF, GAPS_OF) less those ``gone``."""
    out = [(k, r, len(x), x.tobytes()) for k, r, x in rows if len(x)]
    for sign, some in ((1, rows), (-1, gone)) if count else ():
        for k, of in ((DOC, DOCS_OF), (DOC_LEFT, DOCS_OF), (GAP, GAPS_OF), (GAP_LEFT, GAPS_OF)):
            sizes = [x["n"] for kind, _, x in some if kind == k and len(x)]
            if sizes:
                n, c = np.unique(np.concatenate(sizes), return_counts=True)
                out += [(of, a, sign * b, None) for a, b in zip(n.tolist(), c.tolist())]
    cols = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["kind", "range", "n", "rows"])


def joined(u, bin_, at):
    out = np.empty(len(u), PLACED)
    out["u"], out["bin"], out["at"] = u, bin_, at
    return out


def items(n, u):
    out = np.empty(len(n), ITEM)
    out["n"], out["u"] = n, u
    return out


def spread(u):
    """A number in [0, 1) for each row, the same whenever it is asked for."""
    return (mix(u.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def bundles(n, u, size):
    """Consecutive items joined up to ``size``: (items, members), the first member's row standing for its bundle."""
    before = np.cumsum(n.astype(np.int64)) - n
    first = np.r_[True, before[1:] // size != before[:-1] // size] if len(n) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    whole = items(np.add.reduceat(n.astype(np.int64), begin) if len(n) else n, u[begin])
    return whole, joined(u, u[begin][of], before - before[begin][of])


def sweep(docs, gaps):
    """Rows of (documents, gaps) that meet, and both in descending order: each document, the largest first, takes the smallest gap that holds it.

    Going down the sizes, a gap opens a bracket and a document closes the last one that is open.
    """
    docs, gaps = docs[np.lexsort((docs["u"], -docs["n"].astype(np.int64)))], gaps[np.lexsort((gaps["u"], -gaps["n"].astype(np.int64)))]
    size = np.r_[gaps["n"], docs["n"]].astype(np.int64)
    step = np.r_[np.ones(len(gaps), np.int64), -np.ones(len(docs), np.int64)]
    order = np.lexsort((-step, -size))  # stable: both stay in their order
    step = step[order]
    depth = np.cumsum(step) + (step < 0)
    level = np.argsort(depth, kind="stable")
    met = np.flatnonzero((step[level][:-1] > 0) & (step[level][1:] < 0) & (depth[level][:-1] == depth[level][1:]))
    return docs, gaps, order[level[met + 1]] - len(gaps), order[level[met]]


def carry(left):
    """Runs (run, range of documents, from, to, range of gaps, from, to) by which what the sweeps left over meets; left: (documents, gaps) by range."""
    runs, open_ = [], []
    for r in sorted(left):
        docs, gaps = left[r]
        at = 0
        while at < docs and open_:
            q, n = open_.pop()
            take = min(n, docs - at)
            runs.append((len(runs), r, at, at + take, q, n - take, n))
            at += take
            if n > take:
                open_.append((q, n - take))
        if gaps:
            open_.append((r, gaps))
    return runs


def ranges_of(docs: dict[int, int], gaps: dict[int, int], rows: int):
    """Per size the (first range, ranges) of its gaps and of its documents, in descending order of size; and the number of ranges."""
    table, at, held = {}, 0, 0
    for n in sorted({*docs, *gaps}, reverse=True):
        for kind, count in ((GAP, gaps.get(n, 0)), (DOC, docs.get(n, 0))):
            if not count:
                continue
            if held and held + count > rows:
                at, held = at + 1, 0
            wide = -(-count // rows)
            table[kind, n] = (at, wide)
            at, held = (at + wide, 0) if wide > 1 else (at, held + count)
    return table, at + 1


def opening(docs: dict[int, int], gaps: dict[int, int], rest: int, capacity: int):
    """Who opens a sequence: (length over which all do, share of that length, alone). ``rest``: tokens of documents still to enter."""
    top = max(gaps, default=0)
    over = {n: c for n, c in docs.items() if n > top}
    if not over:
        return capacity, 0.0, True
    need = -(-(sum(n * c for n, c in docs.items()) + rest - sum(n * c for n, c in gaps.items())) // capacity)
    own = sum(c / (capacity // n) for n, c in over.items())
    if gaps and need <= own:
        return top, 0.0, False  # all that fit nowhere, a few together
    most = sum(over.values())
    count = min(most, max(need, 0 if gaps else sum(c for n, c in over.items() if n > capacity // 2), 1))
    for n in sorted(over, reverse=True):
        if count <= over[n]:
            return n, count / over[n], True
        count -= over[n]
    return top, 0.0, True


def counted(table: DataFrame) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
    """Documents and gaps of each size that a table's rows add, and what is left in each range."""
    out: tuple[dict, dict, dict] = ({}, {}, {})
    for kind, at, n in table.where(F.col("kind") != PUT).groupBy("kind", "range").agg(F.sum("n")).collect():
        if kind in (DOCS_OF, GAPS_OF):
            out[kind == GAPS_OF][at] = n
        elif kind in (DOC_LEFT, GAP_LEFT):
            out[2].setdefault(at, [0, 0])[kind == GAP_LEFT] = n
    return out


def entered(pieces: DataFrame, floors: list[int], tiny: int, join_tiny: bool) -> DataFrame:
    """The pieces as items: kind DOC with the number of their class in ``range``, and the members of bundles."""

    def run(batches):
        for b in batches:
            n, u = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = []
            if join_tiny:
                small = (n <= tiny) & (spread(u) < 0.875)
                whole, members = bundles(n[small], u[small], 2 * tiny)
                rows.append((MEMBER, 0, members))
                n, u = np.r_[n[~small], whole["n"]], np.r_[u[~small], whole["u"]]
            of = (n[:, None] <= np.array(floors)[None]).sum(1)
            yield batch_of(rows + [(DOC, k, items(n[of == k], u[of == k])) for k in range(len(floors))], count=True)

    return pieces.select("length", "_row").mapInArrow(trimmed(run), STATE)


def one_round(state: DataFrame, docs: dict[int, int], gaps: dict[int, int], rest: int, capacity: int) -> tuple[DataFrame, DataFrame, list[dict]]:
    """What a round places (PUT), the documents and gaps after it (DOC, GAP), and their numbers by size."""
    parts = partitions(state.sparkSession)
    least, share, alone = opening(docs, gaps, rest, capacity)
    table, ranges = ranges_of(docs, gaps, max(RANGE_ROWS, -(-(sum(docs.values()) + sum(gaps.values())) // parts)))

    def deal(batches):
        low = {k: np.array([table.get((k, n), (0, 1)) for n in range(capacity + 1)]) for k in (DOC, GAP)}
        for b in batches:
            out = []
            for kind, rows in zip(b.column(0).to_pylist(), b.column(3)):
                x = np.frombuffer(rows.as_py(), ITEM)
                if kind == DOC and alone:
                    opens = (x["n"] > least) | ((x["n"] == least) & (spread(x["u"]) < share))
                    new, x = x[opens], x[~opens]
                    out.append((PUT, int(spread(new["u"][:1]).sum() * ranges), joined(new["u"], new["u"], 0)))
                    new = new[new["n"] < capacity]
                    out.append((GAP, -1, items(capacity - new["n"], new["u"])))
                if not len(x):
                    continue
                to = low[kind][x["n"], 0] + (spread(x["u"]) * low[kind][x["n"], 1]).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at, begin = np.unique(to[order], return_index=True)
                out += [(kind, int(t), y) for t, y in zip(at, np.split(x[order], begin[1:]))]
            yield batch_of(out)

    def settle(batches):
        held: dict[int, dict[int, list]] = {}
        for b in batches:
            for kind, r, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                x = np.frombuffer(rows.as_py(), PLACED if kind == PUT else ITEM)
                if kind == PUT or r < 0:
                    yield batch_of([(kind, r, x)], count=True)
                else:
                    held.setdefault(r, {}).setdefault(kind, []).append(x)
        for r in sorted(held):
            mine = held.pop(r)
            d, g = (np.concatenate(mine.get(k) or [np.zeros(0, ITEM)]) for k in (DOC, GAP))
            out = []
            if not alone and len(d) and d["n"].max() > least:  # fits nowhere: a few to a new sequence, longest first
                far = d[d["n"] > least]
                far = far[np.lexsort((far["u"], -far["n"].astype(np.int64)))]
                d = d[d["n"] <= least]
                per = capacity // int(far["n"][0])
                begin = np.arange(0, len(far), per)
                sums = np.cumsum(far["n"].astype(np.int64))
                base = np.repeat(np.r_[0, sums[begin[1:] - 1]], np.diff(np.r_[begin, len(far)]))
                first = np.repeat(far["u"][begin], np.diff(np.r_[begin, len(far)]))
                out.append((PUT, r, joined(far["u"], first, sums - far["n"] - base)))
                left = capacity - np.add.reduceat(far["n"].astype(np.int64), begin)
                out.append((GAP, r, items(left[left > 0], far["u"][begin][left > 0])))
            d, g, i, j = sweep(d, g)
            out += met(r, d[i], g[j], capacity)
            out += [(DOC_LEFT, r, np.delete(d, i)), (GAP_LEFT, r, np.delete(g, j))]
            yield batch_of(out, count=True)

    swept = state.mapInArrow(trimmed(deal), STATE).withColumn("_to", F.when(F.col("range") < 0, F.pmod(F.hash(F.spark_partition_id()), F.lit(ranges))).otherwise(F.col("range")))
    swept = materialize(swept.repartition(ranges, "_to").drop("_to").mapInArrow(trimmed(settle), STATE), "swept")
    now = counted(swept)  # two numbers a range, and one a size
    runs = carry(now[2])
    by_docs, by_gaps = {}, {}
    for run, p, a, b, q, c, d in runs:
        by_docs.setdefault(p, []).append((run, a, b))
        by_gaps.setdefault(q, []).append((run, c, d))

    def plain(batches):
        for b in batches:
            out = []
            for kind, r, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                if kind in (DOC_LEFT, GAP_LEFT):
                    x = np.frombuffer(rows.as_py(), ITEM)
                    at = (by_docs if kind == DOC_LEFT else by_gaps).get(r, [])
                    x = x[max((e for _, _, e in at), default=0) :] if kind == DOC_LEFT else x[: min((s for _, s, _ in at), default=len(x))]
                    out.append((DOC if kind == DOC_LEFT else GAP, r, x))
                else:
                    out.append((kind, r, np.frombuffer(rows.as_py(), ITEM)))
            yield batch_of(out)

    placed, after = swept.where(F.col("kind") == PUT), swept.where(F.col("kind").isin(GAP, DOC_LEFT, GAP_LEFT)).mapInArrow(trimmed(plain), STATE)
    if not runs:
        return placed, after, now[:2]

    def slice_(batches):
        for b in batches:
            out = []
            for kind, r, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                x = np.frombuffer(rows.as_py(), ITEM)
                out += [(kind, run, x[s:e]) for run, s, e in (by_docs if kind == DOC_LEFT else by_gaps).get(r, [])]
            yield batch_of(out)

    def meet(batches):
        held: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for kind, run, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                held.setdefault(run, {})[kind] = np.frombuffer(rows.as_py(), ITEM)
                if len(held[run]) == 2:
                    x = held.pop(run)
                    yield batch_of(met(run, x[DOC_LEFT], x[GAP_LEFT][::-1], capacity), [(k, run, y) for k, y in x.items()], True)

    carried = swept.where(F.col("kind").isin(DOC_LEFT, GAP_LEFT)).mapInArrow(trimmed(slice_), STATE)
    carried = materialize(carried.repartition(min(len(runs), parts), "range").mapInArrow(trimmed(meet), STATE), "carried")
    for sizes, more in zip(now, counted(carried)):
        for n, c in more.items():
            sizes[n] = sizes.get(n, 0) + c
    now = [{n: c for n, c in sizes.items() if c} for sizes in now[:2]]
    return placed.unionByName(carried.where(F.col("kind") == PUT)), after.unionByName(carried.where(F.col("kind") == GAP)), now


def met(r, d, g, capacity):
    """What follows when each document goes into the gap beside it."""
    left = g["n"].astype(np.int64) - d["n"]
    return [(PUT, r, joined(d["u"], g["u"], capacity - g["n"].astype(np.int64))), (GAP, r, items(left[left > 0], g["u"][left > 0]))]


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence holds more than ``capacity`` tokens, and offsets leave no hole."""
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not 0 < n <= capacity for n in sizes):
        raise ValueError("lengths must lie between 1 and the capacity")
    total, tiny = sum(n * c for n, c in sizes.items()), max(1, capacity // TINY)
    crowd = sum(c for n, c in sizes.items() if n <= tiny) > 8 * (total // capacity + 1)
    floors = sorted({capacity // 8, capacity // 32, 0}, reverse=True)
    start = materialize(entered(pieces, floors, tiny, crowd), "items")
    classes: list[dict[int, int]] = [{} for _ in floors]
    for n, c in counted(start)[0].items():
        classes[sum(n <= f for f in floors)][n] = c
    put, state, gaps = [], None, {}
    for k, docs in enumerate(classes):
        fresh = start.where((F.col("kind") == DOC) & (F.col("range") == k))
        rest = sum(n * c for later in classes[k + 1 :] for n, c in later.items())
        state = fresh if state is None else state.unionByName(fresh)
        while docs:
            placed, state, (docs, gaps) = one_round(state, docs, gaps, rest, capacity)
            put.append(placed)
    schema = "_row long, sequence_id long, offset long"

    def rows(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), PLACED)
            yield pa.RecordBatch.from_arrays([pa.array(x["u"]), pa.array(x["bin"]), pa.array(x["at"].astype(np.int64))], names=["_row", "sequence_id", "offset"])

    if not put:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).drop("_row").limit(0)
    placed = put[0]
    for p in put[1:]:
        placed = placed.unionByName(p)
    placed = placed.mapInArrow(trimmed(rows), schema)
    if crowd:  # a member lies in its bundle's sequence
        member = start.where(F.col("kind") == MEMBER).mapInArrow(trimmed(rows), schema).toDF("_row", "_whole", "_at")
        inside = member.join(placed.withColumnRenamed("_row", "_whole"), "_whole").select("_row", "sequence_id", (F.col("offset") + F.col("_at")).alias("offset"))
        placed = placed.join(member.select("_row"), "_row", "left_anti").unionByName(inside)
    return pieces.join(placed, "_row").drop("_row")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity, id_col)
