"""The conversation trie against a plain dictionary of prefixes, with passes forced by small limits."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resampla.llm import prefix_trie


def brute(seqs):
    """Nodes of {conv_id: [(role, text), ...]} by the definition."""
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}

    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        saved = (len(m) - 1) * (len(p[-1][1]) if p else 0) + sum(out[k][6] for k in kids[p])
        leaves = sum(out[k][5] for k in kids[p]) or 1
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda x: (x[1], x[0]))


def case(seed, n=300):
    """Hot first turns, copies, long shared heads, prefixes of others, empty and null fields, ties and one long conversation."""
    r = np.random.default_rng(seed)
    rows, seqs = [], {}
    hot = [("user", "hello"), ("bot", "hi"), ("user", "né")] + [("bot", f"step {i}") for i in range(50)]
    for c in range(n):
        kind = c % 6
        if kind == 0:
            s = hot[: int(r.integers(1, 9))]
        elif kind == 1:
            s = hot[:2] + [("user", f"q{int(r.integers(0, 4))}") for _ in range(int(r.integers(0, 5)))]
        elif kind == 2:
            s = hot[:1] + [(["bot", ""][int(r.integers(0, 2))], "") for _ in range(int(r.integers(1, 4)))]
        elif kind == 3:
            s = hot + [("user", f"u{int(r.integers(0, 3))}")] * int(r.integers(0, 3))
        else:
            s = [("user", f"first {int(r.integers(0, 60))}")] + [("bot", "x" * int(r.integers(0, 9)))] * int(r.integers(0, 6))
        seqs[c - 20] = list(s)
        rows += [(c - 20, t, role or None, text or None) for t, (role, text) in enumerate(s)]
    seqs[5000] = [("user", f"t{i}") for i in range(700)]
    rows += [(5000, i, "user", f"t{i}") for i in range(700)]
    seqs[6000] = [("a", ""), ("b", ""), ("a", "x"), ("a", "x"), ("a", "y")]  # null turn first, ties by role and text, repeated rows
    rows += [(6000, 3, "a", "y"), (6000, 3, "a", "x"), (6000, 3, "a", "x"), (6000, None, "b", None), (6000, None, "a", ""), (None, 1, "a", "b")]
    return rows, seqs


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit,skip", [(1 << 17, 32), (200, 32), (200, 3), (1, 32)])
def test_trie_equals_brute_force(spark, monkeypatch, limit, skip):
    monkeypatch.setattr(prefix_trie, "SKIP", skip)
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows, seqs = case(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("key", F.lit("k")).repartition(3)
    sequences = prefix_trie.conversation_sequences(df)
    seqs[7000] = []  # a conversation that lost all its turns
    sequences = sequences.unionByName(spark.createDataFrame([(7000, [])], sequences.schema))
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(sequences, limit).collect()), key=lambda x: (x[1], x[0]))
    assert got == brute(seqs)


@pytest.mark.parametrize("slab", [1, 500])
def test_slabs_cut_between_buckets(spark, monkeypatch, slab):
    monkeypatch.setattr(prefix_trie, "SLAB", slab)
    rows, seqs = case(3, 120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((tuple(r) for r in prefix_trie.trie_nodes(prefix_trie.conversation_sequences(spark.createDataFrame(rows, SCHEMA)), 300).collect()), key=lambda x: (x[1], x[0]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(seqs)


def test_quicksort_groups_by_prefix():
    r = np.random.default_rng(5)
    seqs = list({tuple(r.integers(0, 3, int(r.integers(0, 6))).tolist()) for _ in range(200)})
    ends = np.cumsum([len(s) for s in seqs])
    flat = np.array([x for s in seqs for x in s], np.int64)
    parents, depths, members, tails = prefix_trie.quicksort_nodes(flat, np.r_[0, ends[:-1]], ends, [np.arange(len(seqs))])
    shared = {p: sum(s[: len(p)] == p for s in seqs) for s in seqs for p in [s[:d] for d in range(1, len(s) + 1)]}
    got = {seqs[m[0]][:d]: len(m) for m, d in zip(members, depths)}
    assert got == {p: n for p, n in shared.items() if n > 1} and sorted(int(t[0]) for t in tails) == list(range(len(seqs)))
    assert all(p < i for i, p in enumerate(parents))


def test_empty_and_clashing_codes(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_nodes(prefix_trie.conversation_sequences(empty)).count() == 0
    one = spark.createDataFrame([(4, [])], "conv_id long, turns array<struct<code:long,size:int>>")
    assert [tuple(r) for r in prefix_trie.trie_nodes(one).collect()] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
    monkeypatch.setattr(prefix_trie, "turn_digest", lambda role, text, salt: F.concat(F.lit("0" * 15), F.substring(F.md5(text.cast("binary")), 1, 17)))
    with pytest.raises(ValueError, match="salt"):
        prefix_trie.turn_codes(spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "a", "c")], SCHEMA))
