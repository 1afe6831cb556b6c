from __future__ import annotations

import importlib.util

import pytest

from tests.llm.cases import LONG, documents, empty

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not there", allow_module_level=True)

import corpus_pipeline as cp  # noqa: E402
from gleaner.llm import decision_list as dl  # noqa: E402
from gleaner.llm import secret_scan as ss  # noqa: E402
from tests.llm.test_pairs import components_by_hand  # noqa: E402
from tests.llm.test_tokens import check_pieces, ids_by_doc  # noqa: E402


def test_stages_in_turn(spark, folder):
    """Each stage against its own definition, on what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "secret_scan", "packing"]
    frames = [docs]
    for _, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
        if len(frames) <= 5:
            assert frames[-1].columns == docs.columns and frames[-1].dtypes == docs.dtypes
    quality, language, unique, clean, pieces = frames[1:]
    rules = dl.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in dl.judge(docs, rules).filter("_quality.kept").collect()}
    assert {r.doc_id for r in quality.collect()} == kept
    before, after = {r.doc_id for r in quality.collect()}, {r.doc_id for r in language.collect()}
    assert after <= before and len(after) >= 0.97 * len(before)
    parts = components_by_hand(dict(language.select("doc_id", "text").collect()))
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in parts.items() if i == c}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()}
    assert all(not r._secrets for r in ss.scan(clean, None).collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert check_pieces(pieces.collect(), ids_by_doc(clean)) < 0.05
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.run(spark, folder).collect()} == {
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces.collect()
    }


def test_edge_rows_pass_through_every_stage(spark, folder):
    good = " ".join(f"therst{chr(97 + k % 26)} ofthen{chr(97 + k // 26)}" for k in range(80))
    docs = documents(spark, [None, "", good, good, LONG, good + " token=deadbeefdeadbeefdeadbeefdeadbeef"])
    for _, stage in cp.STAGES[:-1]:
        one = stage(spark, docs, folder)
        assert one.columns == docs.columns
        one.collect()
        assert stage(spark, empty(spark), folder).count() == 0
    assert {r.doc_id for r in cp.packed(spark, docs, folder).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert {r.doc_id for r in cp.near_dedup(spark, docs, folder).collect()} == {1, 2, 3, 5, None}
    assert "deadbeef" not in cp.secrets(spark, docs, folder).filter("doc_id = 6").first().text
