"""Prefix trie of conversations: MSD radix partitioning, finished by multikey quicksort.

Every distinct sequence of first turns is a node.  Turns are encoded by a dictionary of 60-bit codes (``turn_codes``
raises where two turns would share one, and another ``salt`` parts them).  Equal conversations are first folded into
one with a count, so a conversation with a third of all rows is one sequence.

* Radix passes: sequences at a node are counted by their next turn.  A bucket with more than ``local_turns`` turns (by default
  an eighth of a partition's share, between 1,024 and ``LOCAL_TURNS``) is a node of its own and is partitioned again a turn deeper; turns that all of a bucket share are skipped at once (32 a pass), so the
  number of passes follows the branching of large buckets.  Rows are joined to the few large buckets, never gathered.
* Local buckets: dealt to tasks by (node, turn), worked through in slabs of about ``SLAB`` turns; three-way partitions by the
  next turn emit the shared nodes, and the unshared rest of a sequence is emitted as one chain.
* Sums over subtrees go up the recursion, a small aggregation a pass.
* Ids of a node's ends: sorted by range, joined into pieces of at most ``PIECE`` bytes in every range, and hashed
  piece by piece, so a sequence with very many members is a stream, never a list in memory.

A conversation (16 bytes a turn) is held whole in a task, as a text is elsewhere.  Turns lie in order of ``turn``, null first, those that
tie by the first 64 characters of role and text, then by digest; repeated rows are turns of their own.  Null role or text
counts as empty.  Rows without a conversation id belong to none.  Extra columns are not looked at; an empty table gives
no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import discard, materialize, partitions, trimmed

LOCAL_TURNS, SLAB, SKIP, PIECE, BROADCAST_BUCKETS = 1 << 17, 1 << 18, 32, 1 << 20, 100_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

# ---------------------------------------------------------------- sequences


def turn_digest(role: Column, text: Column, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(salt), F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def turn_codes(conversations: DataFrame, salt: str = "") -> DataFrame:
    """(conv_id, at, code, size): every turn's place among those of its conversation, its dictionary code and code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    digest = turn_digest(F.col("role"), F.col("text"), salt)
    at = F.struct("turn", F.left("role", F.lit(64)).alias("r"), F.left("text", F.lit(64)).alias("t"), F.unhex(digest).alias("d"))
    out = materialize(rows.select("conv_id", at.alias("at"), F.length("text").alias("size")), "turns")
    code = F.conv(F.substring(F.hex("at.d"), 1, 15), 16, 10).cast("long")
    clash = out.groupBy(code.alias("code")).agg(F.min("at.d").alias("a"), F.max("at.d").alias("b")).where("a <> b")
    if clash.limit(1).count():
        raise ValueError("two turns share a code: choose another salt")
    return out.select("conv_id", "at", code.alias("code"), "size")


def conversation_sequences(conversations: DataFrame, salt: str = "") -> DataFrame:
    """(conv_id, turns: array of (code, size)) in order."""
    rows = turn_codes(conversations, salt)
    turns = F.transform(F.sort_array(F.collect_list(F.struct("at", "code", "size"))), lambda x: F.struct(x["code"].alias("code"), x["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


# ---------------------------------------------------------------- ends


def join_ids(batches):
    """Pieces (key, first id, ids joined by commas) of rows that are sorted by key and id."""
    key, ids, size = None, [], 0
    out = []

    def close():
        if ids:
            out.append((key, int(ids[0]), ",".join(ids)))

    def flush():
        a, b, c = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["key", "first", "ids"])

    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key or size > PIECE:
                close()
                key, ids, size = k, [], 0
            ids.append(str(i))
            size += len(ids[-1]) + 1
        if len(out) >= 1000 or sum(len(x[2]) for x in out) > PIECE:
            yield flush()
    close()
    if out:
        yield flush()


def hash_pieces(batches):
    """(key, SHA-256 of its pieces, comma-joined) of pieces that are sorted by key and first id."""
    key, held, keys, hashes = None, None, [], []
    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(2)):
            if k != key:
                if held is not None:
                    keys.append(key)
                    hashes.append(held.hexdigest())
                key, held = k, hashlib.sha256()
            else:
                held.update(b",")
            held.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "sha"])
        keys, hashes = [], []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held.hexdigest()], pa.string())], names=["key", "sha"])


def end_hashes(rows: DataFrame) -> DataFrame:
    """(key, sha) of the ids of each key, in numeric order."""
    parts = partitions(rows.sparkSession)
    pieces = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(join_ids, "key binary, first long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(trimmed(hash_pieces), "key binary, sha string")


# ---------------------------------------------------------------- local buckets


def quicksort_nodes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, groups: list[np.ndarray]):
    """Shared nodes and unshared tails of sequences ``codes[start:end]``; each group is a bucket below a node of its own.

    Returns (parents, depths, members) of the shared nodes, parents first (-1 - g: the node above group g), and
    (sequence, node, turns before) of the tails.  Multikey quicksort: a group is split three ways by the turn at its depth; the middle
    part goes a turn deeper and is a node, the outer parts stay at their depth.
    """
    parents, depths, members, tails = [], [], [], []
    stack = [(g, 0, -1 - i) for i, g in enumerate(groups)]
    while stack:
        group, t, node = stack.pop()
        if len(group) == 1:
            tails.append((group[0], node, t))
            continue
        at = start[group] + t
        alive = at < end[group]
        if not alive.all():
            tails += [(s, node, t) for s in group[~alive]]
            group, at = group[alive], at[alive]
            if len(group) <= 1:
                tails += [(s, node, t) for s in group]
                continue
        key = codes[at]
        pivot = key[len(key) // 2]
        same = key == pivot
        if not same.all():
            low = key < pivot
            for part in (group[low], group[~(low | same)]):
                if len(part):
                    stack.append((part, t, node))
            group = group[same]
        if len(group) == 1:
            tails.append((group[0], node, t))
            continue
        parents.append(node)
        depths.append(t + 1)
        members.append(group)
        stack.append((group, t + 1, len(parents) - 1))
    return parents, depths, members, tails


def slab_nodes(node, depth, nxt, codes, start, end, sizes, n, least, sha):
    """All nodes of the buckets of a slab as columns, with whether a node is its bucket's top."""
    cut = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]) | (nxt[1:] != nxt[:-1])])
    groups = np.split(np.arange(len(node)), cut[1:])
    parents, depths, members, tails = quicksort_nodes(codes, start, end, groups)
    k = len(parents)
    above = np.array(parents, np.int64)
    first = np.array([m[0] for m in members], np.int64) if k else np.zeros(0, np.int64)
    conv = np.array([least[m].min() for m in members], np.int64)
    count = np.array([n[m].sum() for m in members], np.int64)
    local = np.array(depths, np.int64)
    own = (count - 1) * sizes[start[first] + local - 1] if k else count
    children, leaves, saved, ends = np.zeros(k, np.int64), np.zeros(k, np.int64), own.copy(), [None] * k
    # tails: one chain each, sums from its end
    seq, at, before = (np.array(c, np.int64) for c in zip(*tails)) if tails else (np.zeros(0, np.int64),) * 3
    length = end[seq] - start[seq] - before
    for i in np.flatnonzero(length == 0):
        if at[i] >= 0:
            ends[at[i]] = sha[seq[i]]
    seq, at, before, length = (c[length > 0] for c in (seq, at, before, length))
    which = np.repeat(np.arange(len(seq)), length)
    stop = np.cumsum(length)
    place = np.arange(len(which)) - np.repeat(stop - length, length)  # 0, 1, ... along each chain
    own_tail = (n[seq][which] - 1) * sizes[start[seq][which] + before[which] + place]
    run = np.cumsum(own_tail)
    whole = run[stop - 1] if len(stop) else run
    tail_saved = whole[which] - run + own_tail
    last = place == length[which] - 1
    inside = at >= 0
    np.add.at(children, at[inside], 1)
    np.add.at(leaves, at[inside], 1)
    np.add.at(saved, at[inside], tail_saved[place == 0][inside])
    for i in range(k - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        p = parents[i]
        if p >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    up = lambda a, f: np.where(a >= 0, conv[np.maximum(a, 0)] if k else 0, node[f])
    base, tail_base = (depth[first] if k else first), depth[seq]
    chain_parent = np.where(place == 0, up(at, seq)[which], least[seq][which])
    tail_sha = [s if z else None for s, z in zip(sha[seq][which], last)]
    columns = [
        np.r_[conv, least[seq][which]], np.r_[base + local, (tail_base + before)[which] + place + 1], np.r_[up(above, first), chain_parent], np.r_[count, n[seq][which]],
        np.r_[children, (~last).astype(np.int64)], np.r_[leaves, np.ones(len(which), np.int64)], np.r_[saved, tail_saved],
    ]
    top = np.r_[above < 0, (place == 0) & (at < 0)[which]]
    return [*(pa.array(c, pa.int64()) for c in columns), pa.array([*ends, *tail_sha], pa.string()), pa.array(top)]


def finish_buckets(batches):
    """Nodes of all buckets of a partition, which is sorted by bucket; a slab ends where a bucket does."""
    held, turns = [], 0
    names = [c.split()[0] for c in NODE.split(", ")] + ["top"]

    def work(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        node, depth, nxt, n, least = (t.column(c).to_numpy() for c in ("node", "depth", "nxt", "n", "id"))
        lists, sizes = t.column("codes").combine_chunks(), t.column("sizes").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        sha = np.array(t.column("sha").to_pylist(), object)
        done = pa.RecordBatch.from_arrays(slab_nodes(node, depth, nxt, flat, offsets[:-1], offsets[1:], sizes.flatten().to_numpy().astype(np.int64), n, least, sha), names=names)
        for lo in range(0, len(done), 1 << 16):
            yield done.slice(lo, 1 << 16)

    for b in batches:
        if not len(b):
            continue
        if turns >= SLAB:  # what goes on in this batch waits for its bucket's end
            key = [held[-1].column(c)[len(held[-1]) - 1] for c in range(3)]
            new = np.flatnonzero(~np.all([b.column(c).to_numpy() == key[c].as_py() for c in range(3)], axis=0))
            if len(new):
                yield from work([*held, b.slice(0, int(new[0]))] if new[0] else held)
                held, turns, b = [], 0, b.slice(int(new[0]))
        held.append(b)
        turns += len(b.column(b.schema.get_field_index("codes")).flatten())
    if held:
        yield from work(held)


# ---------------------------------------------------------------- radix passes


def common_length(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    found = F.array_position(same, False)
    return F.when(found > 0, found - 1).otherwise(F.size(same).cast("long"))


def split_large(work: DataFrame, local_turns: int, level: int) -> tuple[DataFrame, DataFrame | None]:
    """A pass: (rows with their large bucket, or null, as ``big``; the large buckets as units of nodes, or None)."""
    nxt = F.get("codes", F.col("depth").cast("int"))
    rest = F.slice("codes", F.col("depth").cast("int") + 2, F.lit(SKIP))
    keyed = work.withColumn("nxt", nxt)
    counted = keyed.where("nxt is not null").groupBy("node", "depth", "nxt").agg(
        F.count("*").alias("rows"), F.sum(F.size("codes") - F.col("depth")).alias("turns"), F.sum("n").alias("n_convs"), F.min("id").alias("first"),
        F.min(rest).alias("a"), F.max(rest).alias("b"), F.any_value(F.slice("sizes", F.col("depth").cast("int") + 1, F.lit(SKIP + 1))).alias("s"))
    large = counted.where((F.col("rows") > 1) & (F.col("turns") > local_turns)).withColumn("skip", common_length(F.col("a"), F.col("b")))
    units = materialize(large.select("node", "depth", "nxt", F.col("first").alias("to_node"), (F.col("depth") + 1 + F.col("skip")).alias("to_depth"), "n_convs", F.slice("s", F.lit(1), F.col("skip").cast("int") + 1).alias("chain")), f"units{level}")
    count = units.count()
    if not count:
        return keyed.select("*", F.lit(None).cast("long").alias("to_node"), F.lit(None).cast("long").alias("to_depth")), None
    small = units.select("node", "depth", "nxt", "to_node", "to_depth")
    return keyed.join(F.broadcast(small) if count <= BROADCAST_BUCKETS else small, ["node", "depth", "nxt"], "left"), units


def trie_nodes(sequences: DataFrame, local_turns: int | None = None) -> DataFrame:
    """All nodes of the trie of ``sequences`` (conv_id, turns: array of (code, size))."""
    spark = sequences.sparkSession
    parts = partitions(spark)
    codes, sizes = F.transform("turns", lambda x: x["code"]), F.transform("turns", lambda x: x["size"])
    keyed = sequences.select(F.col("conv_id").alias("id"), codes.alias("codes"), sizes.alias("sizes"))
    keyed = materialize(keyed.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("codes").cast("array<string>")).cast("binary")))), "sequences")
    folded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.any_value("codes").alias("codes"), F.any_value("sizes").alias("sizes"))
    work = folded.join(end_hashes(keyed.select("key", "id")), "key").drop("key")
    total = keyed.agg(F.count("*").alias("n"), F.min("id").alias("id"), F.sum(F.size("codes")).alias("turns")).first()
    if not total["n"]:
        return spark.createDataFrame([], NODE)
    local_turns = local_turns or min(LOCAL_TURNS, max(1024, total["turns"] // (8 * parts)))
    root = spark.createDataFrame([(None, None, None, total["id"], 0, total["n"], [0])], "node long, depth long, nxt long, to_node long, to_depth long, n_convs long, chain array<int>")
    levels, local, ended, scratch = [root], [], [], [keyed]
    work = work.select(F.lit(total["id"]).alias("node"), F.lit(0).cast("long").alias("depth"), "codes", "sizes", "n", "id", "sha")
    while True:
        held = materialize(work, f"level{len(levels)}")
        scratch.append(held)
        split, units = split_large(held, local_turns, len(levels))
        here = split.where("to_node is null")
        ended.append(here.where("nxt is null").select(F.col("node").alias("to_node"), F.col("depth").alias("to_depth"), "sha"))
        at = F.col("depth").cast("int") + 1
        local.append(here.where("nxt is not null").select("node", "depth", "nxt", *[F.slice(c, at, F.greatest(F.size(c), F.lit(1))).alias(c) for c in ("codes", "sizes")], "n", "id", "sha"))
        if units is None:
            break
        levels.append(units)
        work = split.where("to_node is not null").select(F.col("to_node").alias("node"), F.col("to_depth").alias("depth"), "codes", "sizes", "n", "id", "sha")
    buckets = local[0]
    for x in local[1:]:
        buckets = buckets.unionByName(x)
    dealt = buckets.repartition(parts, "node", "depth", "nxt").sortWithinPartitions("node", "depth", "nxt")
    below = materialize(dealt.mapInArrow(trimmed(finish_buckets), NODE + ", top boolean"), "nodes")
    ends = ended[0]
    for x in ended[1:]:
        ends = ends.unionByName(x)
    out = below.drop("top")
    # sums of what hangs below each unit: tops of local buckets, and the units a level deeper
    hanging = below.where("top").groupBy(F.col("parent_conv_id").alias("to_node"), (F.col("depth") - 1).alias("to_depth")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    for units in reversed(levels):
        known = units.join(hanging, ["to_node", "to_depth"], "left").join(ends, ["to_node", "to_depth"], "left")
        spent = F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n_convs") - 1)
        done = known.select("node", "depth", "to_node", "to_depth", "n_convs", "chain", "sha", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("l", F.lit(1)).alias("l"), F.coalesce("s", F.lit(0)).alias("s")).withColumn("top_saved", F.col("s") + spent)
        done = materialize(done, "unit-sums")
        last = F.size("chain") - 1
        each = done.select("*", F.posexplode("chain").alias("i", "size"))
        saved = F.col("s") + F.aggregate(F.slice("chain", F.col("i") + 1, F.size("chain")), F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n_convs") - 1)
        out = out.unionByName(each.select(
            F.col("to_node").alias("conv_id"), (F.col("to_depth") - last + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("node")).otherwise(F.col("to_node")).alias("parent_conv_id"), "n_convs",
            F.when(F.col("i") == last, F.col("c")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("l").alias("n_leaves"), saved.alias("saved_tokens"), F.when(F.col("i") == last, F.col("sha")).alias("ends_sha256")))
        if units is not root:
            more = done.groupBy(F.col("node").alias("to_node"), F.col("depth").alias("to_depth")).agg(F.count("*").alias("c"), F.sum("l").alias("l"), F.sum("top_saved").alias("s"))
            both = hanging.unionByName(more)
            hanging = materialize(both.groupBy("to_node", "to_depth").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s")), "hanging")
    discard(keyed)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
