"""The registered corpus queries on the smallest tables, and what the classifiers may learn from."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from resampla.llm import quality, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLE[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    tidy = lambda rows: sorted(map(repr, rows))
    assert tidy(map(tuple, ours.select(*cols).collect())) == tidy(theirs.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name,fold,held,label", [("op1_toxicity", 4, 2, "toxic"), ("op6_quality_classifier", 5, 0, "quality")])
def test_classifier_queries(spark, name, fold, held, label):
    got = queries.QUERIES[name](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held
    other = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    texts = docs.withColumn("text", F.when(out, F.lit("changed")).otherwise(F.col("text")))
    a = quality.labelled_sample(docs, labels, label, fold, held, {0: 50, 1: 50})
    b = quality.labelled_sample(texts, other, label, fold, held, {0: 50, 1: 50})
    assert a[0] == b[0] and (a[1] == b[1]).all() and a[2] == b[2] and len(a[0]) > 5


def test_convolution_equals_plain_loops():
    net, r = quality.ByteConv(), np.random.default_rng(2)
    net.p["b"][:], net.p["b1"][:] = r.normal(size=quality.FILTERS), r.normal(size=quality.HIDDEN)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 300, 1000)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = net.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, row in zip(texts, got):
        padded = [*t, *[256] * (quality.WIDTH - 1)]
        z = np.array([np.concatenate([net.p["emb"][c] for c in padded[i : i + quality.WIDTH]]) @ net.p["w"] for i in range(len(t))])
        starts = range(0, max(1, -(-len(t) // quality.CELL) - 1) * quality.CELL, quality.CELL) if t else []
        chunks = [z[s : s + 2 * quality.CELL].max(0) for s in starts]
        h = [np.maximum(np.maximum(c + net.p["b"], 0) @ net.p["w1"] + net.p["b1"], 0) for c in chunks]
        want = np.r_[np.mean(h, 0), np.max(h, 0)] if h else np.zeros(2 * quality.HIDDEN)
        assert row == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_ids_of_the_packing_query(spark):
    got = queries.op7_best_fit_packing(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.where("offset + length > 2048").count() == 0


def test_shards_of_the_query(spark):
    got = queries.op12_hilbert_sharding(spark, SMALL).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(docs) and all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 16, zlib.crc32(docs[r["doc_id"]])) for r in got)
    counts = np.bincount([r["shard"] for r in got], minlength=40)
    assert len(counts) == 40 and counts.max() - counts.min() <= 1 and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and all(0 <= r["slot"] < counts[r["shard"]] for r in got)
