"""The pipeline stage by stage."""

import corpus_pipeline
from lattiq.llm import mixing, suffix_dedup
from lattiq.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_one_another(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before.keys() and len(ids) > 100, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_run_on_an_empty_and_an_odd_table(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, "***", "en", "a", 3), (4, "A small text of some words in it.", "en", "a", 9), (4, "A small text of some words in it.", "en", "a", 9), (None, "Another small text with other words.", "en", None, 1)]
    for k, data in enumerate((rows, [])):
        spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as taken", "1 as __n").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert {r["doc_id"] for r in out} <= {4, None}


def test_mixed_copies_and_cut_texts_keep_their_rows(spark):
    docs = table(spark, SF, "documents")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.training_order(docs).groupBy("doc_id").count().collect()}
    for doc, (n, size) in taken.items():
        assert copies.get(doc, 0) == (int(n / size + 0.5) if size else 0)
    cut = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    full = {r["row"]["doc_id"]: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert set(cut) == {d for d, r in full.items() if not r["n_removed"] or r["kept"]}
    assert all(r["n_chars"] == len(r["text"]) for d, r in cut.items() if full[d]["n_removed"])
