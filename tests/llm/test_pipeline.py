"""The pipeline and the registered queries on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from apidrift.llm import mixing, packing, pii, quality, simhash
from apidrift.llm.common import table
from apidrift.llm.queries import ORACLE, QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "target_mix", "packing"]


def test_exact_top_k_matches_sql(spark):
    engine = duckdb.connect()
    engine.execute(f"create view embeddings as select * from '{TABLES}/embeddings.parquet'")
    expected = sorted(engine.execute(ORACLE["op8_exact_top_k"]).fetchall())
    assert sorted(map(tuple, QUERIES["op8_exact_top_k"](spark, str(TABLES)).collect())) == expected


def test_pipeline_is_its_stages(spark):
    docs, labels = table(spark, str(TABLES), "documents"), table(spark, str(TABLES), "labels")
    kept = quality.quality_verdicts(docs, labels).filter("kept").select("doc_id").collect()
    good = quality.keep_good(docs, labels)
    assert sorted(good.select("doc_id").collect()) == sorted(kept) and good.columns == docs.columns
    single = simhash.drop_near_duplicates(good)
    components = simhash.near_duplicates(good).select("component_id").distinct().collect()
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in components)
    clean = corpus_pipeline.personal_data(spark, single, str(TABLES))
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert not any(pii.base_spans(r.text) for r in clean.collect())
    mixed = mixing.mixed(clean, labels)
    expected = packing.pack(mixed).groupBy().sum("length").first()[0]
    found = corpus_pipeline.run(spark, str(TABLES))
    assert found.groupBy().sum("length").first()[0] == expected
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_stages_on_odd_rows(spark, docs_of, odd_rows):
    for rows in (odd_rows, []):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(TABLES))
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns


def test_entry_works_without_this_subpackage(monkeypatch):
    for missing in ("apidrift.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as patch:
            patch.setitem(sys.modules, missing, None)
            assert "breaking_changes" in contract.queries() and "pipeline" not in contract.queries()
