import sys

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    kept = [set(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from kinmat.session import settle

        docs = settle(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept[-1]
        kept.append(set(ids))
    assert len(kept[1]) < len(kept[0]) and kept[4] == kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == kept[-1]
    bins = {}
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        assert sum(n for _, n in members) == max(o + n for o, n in members) <= corpus_pipeline.CAPACITY


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept long, score string, spans int, node int, key_1 int"
    rows = [(1, None, None, None, None, 1, "a", 1, 1, 1), (None, "", "en", "s", 0, 2, "b", 2, 2, 2), (2, "word " * 60_000, "xx", "s", 1, 3, "c", 3, 3, 3), (2, "word " * 60_000, "xx", "s", 1, 3, "c", 3, 3, 3)]
    rows += [(10 + i, " ".join(f"term{(i * 7 + j) % 97} and{j}" for j in range(60)), "en", "s", 1, 4, "d", 4, 4, 4) for i in range(20)]
    docs = spark.createDataFrame(rows, schema)
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, SMALL)
    found = out.collect()
    if stage < 4:
        assert out.columns == docs.columns
        same = {r["doc_id"]: (r["kept"], r["score"], r["spans"], r["node"], r["key_1"]) for r in found}
        given = {r[0]: r[5:] for r in rows}
        assert all(given[d] == v for d, v in same.items())
    assert function(spark, docs.limit(0), SMALL).collect() == []


def test_the_entry_does_without(monkeypatch):
    import importlib

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("kinmat.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kinmat.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.raises(ImportError):
        importlib.import_module("corpus_pipeline")
