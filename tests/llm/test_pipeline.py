"""The pipeline's stages, each against what the one before kept."""

from __future__ import annotations

import re

import numpy as np
import pytest
from test_dedup import linked, norm

import corpus_pipeline
from headway.llm.quality import fit_quality


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    sf_dir, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "packing"]
    for name in list(results)[1:-1]:
        assert results[name].columns == results["documents"].columns


def test_each_stage_decides(results):
    all_docs, good, distinct, apart, mixed = (rows(results[n]) for n in list(results)[:-1])
    assert set(good) < set(all_docs) and len(good) > 0.8 * len(all_docs)
    first = {}
    for i in sorted(good):
        first.setdefault(norm(good[i]), i)
    assert set(distinct) == set(first.values())
    listed = sorted(distinct.items())
    assert set(apart) == {i for (i, _), (_, _, c) in zip(listed, linked(listed), strict=True) if i == c}
    assert set(mixed) <= set(apart)
    counts = results["mix"].groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert counts <= corpus_pipeline.MIX_EPOCHS
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert 0.75 <= words(results["mix"]) / words(results["near_dedup"]) <= 1.2


def test_quality_keeps_what_compresses_like_good_text(spark, results):
    import zstandard

    model = fit_quality(results["documents"], spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))

    def score(text):
        raw = (text or "").encode()
        saved = len(bad.compress(raw)) - len(good.compress(raw)) if raw else 0
        return np.interp((saved + 50 * model.typical) / (len(raw) + 50), model.calibration.boundaries.toArray(), model.calibration.predictions.toArray())

    docs = rows(results["documents"])
    assert set(rows(results["quality"])) == {i for i, t in docs.items() if score(t) >= 0.3}


def test_packing_covers_what_was_mixed(results):
    pieces = results["packing"]
    assert pieces.select("doc_id").distinct().count() == results["mix"].select("doc_id").distinct().count()
    total = pieces.agg({"length": "sum"}).first()[0]
    assert pieces.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0] == total
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` <> 4096").count() <= 1


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, name string, score double"
    some = spark.createDataFrame([(1, None, None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None, None), (2, "", "en", "src1", 0, "i", 1, "n", 0.5), (None, "a b", "xx", "", 3, "i", 1, "n", 0.5)], schema)
    for docs in (some, some.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
