"""The pipeline's stages on a small corpus, each against a plain version of its own input."""

import collections
import itertools

import numpy as np
import pytest
from test_corpus import WORDS, components, prose, sets_of

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(6)
    at, texts = str(tmp_path_factory.mktemp("sf")), {}
    for i in range(160):
        texts[i] = prose(r, int(r.integers(30, 90)))
    for i in range(160, 240):
        texts[i] = " ".join(w.upper() + "!!" for w in r.choice(WORDS, 50))
    for i in range(0, 40):
        texts[i] = "Shared footer line here.\n" + texts[i]
    texts[240], texts[241] = texts[50], texts[51] + " tail"
    item = prose(r, 30)
    texts[242] = prose(r, 20) + " " + item.upper() + " " + prose(r, 20)
    texts[243], texts[244] = "", None
    docs = spark.createDataFrame([(i, t, "en", "s%d" % (i % 4 if i >= 40 else 0), len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, texts


def test_stages(spark, corpus, monkeypatch):
    at, docs, texts = corpus
    train = corpus_pipeline.quality.train_quality
    monkeypatch.setattr(corpus_pipeline.quality, "train_quality", lambda d, l: train(d, l, 100, 150))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, at)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r for r in good.collect()}
    assert len(set(range(160)) - kept.keys()) <= 2 and len(set(range(160, 240)) & kept.keys()) <= 2

    lines = {r["doc_id"]: r for r in stages["line_dedup"](spark, good, at).collect()}
    total = collections.Counter(r["source"] for r in kept.values())
    count = collections.Counter((r["source"], x) for r in kept.values() for x in {y.strip(" ") for y in (r["text"] or "").split("\n")} if x)
    assert lines.keys() == kept.keys()
    for i, r in kept.items():
        cut = [x.strip(" ") for x in (r["text"] or "").split("\n") if x.strip(" ")]
        rest = [x for x in cut if not (count[r["source"], x] >= 2 and count[r["source"], x] > 0.1 * total[r["source"]])]
        assert lines[i]["text"] == (r["text"] if len(rest) == len(cut) else "\n".join(rest))
    assert "Shared footer" not in (lines[3]["text"] if 3 in lines else "")

    frame = spark.createDataFrame(list(lines.values()), docs.schema)
    unique = {r["doc_id"]: r["text"] for r in stages["ngram_jaccard"](spark, frame, at).collect()}
    sets = sets_of({i: r["text"] for i, r in lines.items()}, 5)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert unique.keys() == {i for i in sets if want[i] == i} and len(unique) < len(sets)

    frame = frame.where(frame.doc_id.isin(list(unique)))
    clean = stages["benchmark_decontamination"](spark, frame, at)
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == unique.keys() - {242}
    packed = stages["best_fit_packing"](spark, clean, at).collect()
    assert {r["doc_id"] for r in packed} == unique.keys() - {242}


def test_run_covers_all_stages(spark, corpus, monkeypatch):
    at, _, texts = corpus
    train = corpus_pipeline.quality.train_quality
    monkeypatch.setattr(corpus_pipeline.quality, "train_quality", lambda d, l: train(d, l, 60, 80))
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and 100 < out.count() <= len(texts)
