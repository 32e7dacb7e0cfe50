import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, database
from lanewise.llm import cascade, decontaminate, queries, simhash
from lanewise.llm.stages import staged

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    line, same = compare(spark, database(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert same, line


@needs_data
def test_pipeline_equals_plain_loops_up_to_the_sample(spark):
    """Quality, lines, near duplicates and leaks by brute force on the small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {k: r["text"] for k, r in rows.items()}
    texts = {k: t for k, t in texts.items() if not any(r.rejects(cascade.Text(t)) for r in cascade.RULES)}
    sites = {}
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" \t\n\v\f\r"), set()).add(rows[k]["source"])
    texts = {
        k: "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip(" \t\n\v\f\r")]) < 10)
        for k, t in texts.items()
    }
    prints = {k: simhash.fingerprint(t, 4) for k, t in texts.items()}
    label = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()}
    texts = {k: t for k, t in texts.items() if label[k] == k}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    searcher = decontaminate.Searcher([decontaminate.Item(*r) for r in items], 0.8, 20, 8)
    texts = {k: t for k, t in texts.items() if not searcher.find(t)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    drawn = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in drawn} <= texts.keys() and drawn
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in drawn}


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    """Each stage on nulls, repeats, long texts, clashing columns, and on no row."""
    item = " ".join(f"item{k}" for k in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {(r["doc_id"], r["text"]) for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, str(tmp_path))
        rows = found.collect()
        assert set(corpus_pipeline.COLUMNS) <= set(found.columns), name
        assert {r["doc_id"] for r in rows} <= {k for k, _ in before}
        if name not in ("line dedup",):
            assert {(r["doc_id"], r["text"]) for r in rows} <= before
        none = stage(spark, odd.limit(0), str(tmp_path))
        assert set(corpus_pipeline.COLUMNS) <= set(none.columns) and none.count() == 0
    kept = corpus_pipeline.STAGES[2][1](spark, odd, str(tmp_path)).collect()
    # The repeated prose and its copies under other ids stay once, at the smallest id.
    assert [r["doc_id"] for r in kept].count(1) == 2 and all(r["doc_id"] != 6 for r in kept)
    empty = spark.createDataFrame([], "item_id long, text string")
    empty.write.mode("overwrite").parquet(f"{tmp_path}/none/benchmark.parquet")
    leaks_of_none = corpus_pipeline.STAGES[3][1](spark, odd, f"{tmp_path}/none")
    assert leaks_of_none.count() == odd.count()
