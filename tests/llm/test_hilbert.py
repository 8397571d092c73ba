"""Hilbert sharding: the curve itself, the laws against plain Python, awkward rows, and what pruning saves."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resampla.llm import hilbert


def test_curve_visits_neighbours(spark):
    """Every cell is visited once, and each step changes one coordinate by one."""
    for n, bits in ((1, 4), (2, 4), (3, 3), (4, 2), (5, 1)):
        digits, states = hilbert.curve_tables(n)
        place = {}
        for x in itertools.product(range(1 << bits), repeat=n):
            h = s = 0
            for i in reversed(range(bits)):
                k = (s << n) + sum((c >> i & 1) << j for j, c in enumerate(x))
                h, s = (h << n) + digits[k], states[k]
            place[h] = x
        path = [place[h] for h in range(1 << n * bits)]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
        if n in (2, 3):
            df = spark.createDataFrame([(h, *x) for h, x in place.items()], ["h", *[f"x{j}" for j in range(n)]])
            df = df.select("h", *[F.col(f"x{j}").cast("int").alias(f"x{j}") for j in range(n)])
            assert df.where(hilbert.curve_place([F.col(f"x{j}") for j in range(n)], bits) != F.col("h")).count() == 0


def awkward(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), ["en", "de", None][i % 3], f"site-{i % 7}", float(r.exponential(50)), "x" * int(r.integers(0, 90)), "a", i % 5) for i in range(500)]
    rows += [(1000 + i, "en", "site-1", 7.0, "one copy", "b", 0) for i in range(300)]  # agree in all but the id
    rows += [(77, "en", "site-2", 1.0, "again", "c", 1)] * 4 + [(None, None, None, None, None, None, None)] * 3
    rows += [(2000, "", "site-", float("nan"), "", "d", 2), (2001, "é", "site-9", float("inf"), "é" * 50, "e", 3), (2002, "en", "site-1", -float("inf"), "z" * 30000, "f", 4)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, weight double, text string, shard string, slot int"), rows


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("shards", [1, 7, 40, 5000])
def test_laws_equal_plain_python(spark, law, shards):
    df, rows = awkward(spark)
    got = hilbert.hilbert_shards(df, ["lang", "source", "weight", "doc_id"], shards, law).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, _, _, _, t, _, _ in rows)
    assert collections.Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    by = collections.defaultdict(list)
    for g in got:
        by[g["shard"]].append(g)
    assert all(0 <= s < shards and sorted(g["slot"] for g in x) == list(range(len(x))) for s, x in by.items())
    order = sorted(got, key=lambda g: (g["shard"], g["slot"]))
    none = lambda x: (x is not None, x or 0)
    assert [(g["place"], g["text_crc32"], none(g["doc_id"])) for g in order] == sorted((g["place"], g["text_crc32"], none(g["doc_id"])) for g in got)
    if law == "rows":
        n = [len(by[s]) for s in range(shards)]
        assert max(n) - min(n) <= 1
    else:
        total, done = sum(g["size"] for g in got), 0
        for g in order:
            assert g["shard"] == min(shards - 1, (2 * done + g["size"]) * shards // (2 * total))
            done += g["size"]


def test_same_result_for_any_partitioning(spark):
    df, _ = awkward(spark)
    key = lambda rows: collections.Counter(tuple(r) for r in rows)
    a, b = (key(hilbert.hilbert_shards(d, ["lang", "weight"], 9).collect()) for d in (df, df.repartition(3)))
    assert a == b


def test_cells_are_equally_filled_and_ordered(spark):
    r = np.random.default_rng(3)
    values = np.r_[r.exponential(10, 4000), r.normal(500, 3, 4000)]
    df = spark.createDataFrame([(float(v), f"https://host-{int(v):05d}.example/") for v in values], "v double, s string")
    coded, at = hilbert.cells(df, ["v", "s"], 4)
    got = coded.select("v", "s", at[0].alias("a"), at[1].alias("b")).orderBy("v").collect()
    assert [g["a"] for g in got] == sorted(g["a"] for g in got)
    bs = sorted((g["s"], g["b"]) for g in got)
    assert [b for _, b in bs] == sorted(b for _, b in bs)
    n = collections.Counter(g["a"] for g in got)
    assert len(n) == 16 and max(n.values()) < 2 * 500 and len({b for _, b in bs}) > 8


def test_errors_and_empty_tables(spark):
    df, _ = awkward(spark)
    assert hilbert.hilbert_shards(df.limit(0), ["lang"], 4).count() == 0
    assert hilbert.hilbert_shards(df.limit(0), ["lang"], 4, "bytes").count() == 0
    for bad in (dict(law="key"), dict(shards=0), dict(dims=[]), dict(dims=["lang"] * 6), dict(dims=["x"])):
        with pytest.raises(ValueError):
            hilbert.hilbert_shards(df.withColumn("x", F.array("doc_id")), **({"dims": ["lang"], "shards": 3} | bad))


def test_pruning_by_every_column(spark, tmp_path):
    """Shards of written rows: a range of any column leaves fewer shards than a sort by one column would for the others."""
    r = np.random.default_rng(2)
    rows = [(int(i), f"l{int(r.integers(0, 64)):02d}", float(r.uniform(0, 1000)), "text %d" % i) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, score double, text string")
    man = hilbert.write_shards(df, str(tmp_path / "out"), ["lang", "score"], 64)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert man.count() == 64 and sorted(tuple(x) for x in back.select(*df.columns).collect()) == sorted(rows)
    for wanted in (dict(score=(400.0, 430.0)), dict(lang=("l10", "l12")), dict(score=(None, 20.0)), dict(lang=("l60", None), score=(900.0, None))):
        kept = {x["shard"] for x in hilbert.pruned(man, **wanted).collect()}
        inside = F.lit(True)
        for c, (a, b) in wanted.items():
            inside = inside & (F.col(c) >= a if a is not None else F.lit(True)) & (F.col(c) <= b if b is not None else F.lit(True))
        holding = {x["shard"] for x in back.where(inside).select("shard").distinct().collect()}
        assert holding <= kept and len(kept) <= 24
    with pytest.raises(ValueError):
        hilbert.write_shards(back, str(tmp_path / "again"), ["lang"], 2)
