import importlib
import sys

import corpus_pipeline
from lumen.llm.common import read_table


def test_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = read_table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    bench = [" ".join(r["text"].lower().split()) for r in read_table(spark, folder, "benchmark").collect()]
    known = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == read_table(spark, folder, "documents").columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert set(rows) <= known
        if name != "mixing":
            assert len(rows) == len(set(rows)) <= before
        if name == "decontamination":
            flat = [" ".join(t.lower().split()) for _, t in rows]
            assert not any(b in t for b in bench for t in flat)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count()


def test_run_registered(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries}
    assert queries["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_without_the_package(monkeypatch):
    """The guard drops these queries only, and only for the missing package."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    fresh = importlib.util.module_from_spec(importlib.util.find_spec("__spark_entry__"))
    fresh.__spec__.loader.exec_module(fresh)
    assert not any(q.startswith("op") or q == "pipeline" for q in fresh.queries())
    assert set(fresh.oracle_sql()) < set(entry.oracle_sql()) or not entry.LLM_ORACLE
