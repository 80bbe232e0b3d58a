"""The queries of the subpackage, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathrank.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_comes_back(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir).cache()
    table, key = ("pages", "page_id") if name.startswith("op12") else ("documents", "doc_id")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name.startswith(("op11", "op13")):  # summaries: the SQL tells which rows there are
        assert name in ORACLES
    else:
        assert df.select(key).distinct().count() == n
        assert name.startswith("op10") or df.count() == n
    if name in ORACLES:
        for table in ("documents", "benchmark", "labels"):
            duckdb.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        want = duckdb.sql(ORACLES[name])
        assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())
    df.unpersist()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert after and set(after) <= set(before)
        if name in ("toxicity", "simhash_near_dedup"):
            assert all(r == before[i] for i, r in after.items()) and len(after) < len(before)
        else:
            assert set(after) == set(before) and any(r.text != before[i].text for i, r in after.items())
            assert all(r.n_chars == len(r.text) for r in after.values())
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_leave_no_tables_of_their_own(spark, sf_dir):
    from pathlib import Path

    from pathrank.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    names = lambda: {p.name for p in folder.iterdir() if p.name.startswith(("table-", "window_index_"))} | {p.name for p in folder.glob("window_index_*/*")}
    before = names()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert {n for n in names() - before if not n.startswith("window_index_")} == set()


def odd_rows(spark):
    long = " ".join(f"wort{k % 977}x{k % 31}" for k in range(20_000))
    texts = [None, "", "  \n ", "one", long, long, "the same few words again and again " * 30, "the same few words again and again " * 30, "ÀÉ 東京 " * 50]
    rows = [(k, t, "en", "?", None, "extra") for k, t in enumerate(texts)] + [(3, "one", "en", None, 3, None), (4, long, None, None, None, None), (None, "a row without an id", "en", "s", 1, "x")]
    names = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    docs = spark.createDataFrame(rows, names)
    for c in ("starts", "_spans", "h", "fp", "node", "root", "copy", "row", "d", "known", "score"):  # names that operators use inside
        docs = docs.withColumn(c, F.lit("?"))
    return docs


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, stage):
    docs, run = odd_rows(spark), dict(corpus_pipeline.STAGES)[stage]
    before = sorted(docs.collect(), key=repr)
    nothing = run(spark, docs.where("false"), sf_dir)
    assert nothing.count() == 0
    after = run(spark, docs, sf_dir).collect()
    if stage == "best_fit_packing":
        assert sorted(r.length for r in after if r.doc_id == 0) == [1] and {r.doc_id for r in after} == {r.doc_id for r in before}
        return
    assert nothing.columns == docs.columns
    if stage == "toxicity":
        assert sorted(after, key=repr) == before
    elif stage == "simhash_near_dedup":  # null, empty and blank texts are copies; ids that stay keep all their rows
        assert sorted(after, key=repr) == [r for r in before if r.doc_id in (None, 0, 3, 4, 6, 8)]
    else:
        changed = {r.doc_id for r in before if r not in after}
        assert len(after) == len(before) and all(r.spans in ("extra", None, "x") and r.known == "?" for r in after)
        if stage == "substring_dedup":
            assert {r.doc_id: r.text for r in after if r.doc_id in (5, 7)} == {5: "", 7: ""} and {r.text for r in after if r.doc_id == 4} == {r.text for r in before if r.doc_id == 4}
            assert changed == {r.doc_id for r in after if r.n_chars != next(b.n_chars for b in before if b.doc_id == r.doc_id)}
