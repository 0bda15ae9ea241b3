"""The stages of the pipeline, each on what the one before kept."""

import fixtures as X
from compare import SMALL

import corpus_pipeline
from heddle.llm import blocks, pii


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = blocks.saved(stage(spark, docs, SMALL))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        rows = [(i, t) for i, t in before.items()]
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c in X.components(rows) if i == c}
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {i for i, _, hit, _ in X.leaks(rows, items) if not hit}
        if name == "pii":
            assert set(after) == set(before) and all(not pii.spans(before[i]) or after[i] != before[i] for i in after)
        before = after


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and all(sum(name.startswith(f"op{n}_") for name in found) == 1 for n in range(1, 14))


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    data = X.rows()
    sf = str(tmp_path)
    spark.createDataFrame([(i, int(len(t or "") > 300), 0) for i, t, *_ in data if i] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x y"), (3, data[0][1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for rows in (data, []):
        docs = X.with_clashes(X.frame(spark, rows))
        columns, n = docs.columns, len(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = blocks.saved(stage(spark, docs, sf))
            if name != "best_fit_packing":
                assert docs.columns == columns and docs.count() <= n
                n = docs.count()
        assert (docs.count() >= n > 0) if rows else docs.isEmpty()
