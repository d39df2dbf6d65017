"""The pipeline's stages on the small tables against their operators' plain versions."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sets = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs, SF).schema)
        assert name == "bpe" or docs.columns == columns
        sets.append((name, before, {r["doc_id"]: r.asDict() for r in docs.collect()}))
    (_, all_, clean), (_, _, cut), (_, whole, single), (_, mixed, safe), (_, last, coded) = sets
    assert set(clean) <= set(all_) and len(all_) - len(clean) <= 0.1 * len(all_)
    want = brute_lines({i: r["text"] for i, r in clean.items()}, 2, 20)
    assert set(cut) == {i for i, (kept, n, gone) in want.items() if kept or not gone}
    assert all([x for x in r["text"].split("\n") if x.strip()] == want[i][0] and r["n_chars"] == len(r["text"]) for i, r in cut.items())
    assert set(single) == {i for i, (_, c) in brute.near_duplicates(whole, 5).items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(safe) == {i for i, x in brute.decontamination(mixed, items).items() if not x[1]}
    assert set(coded) == set(last) and all(r["ids_sha256"] for r in coded.values())


def test_toxic_documents_go(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").collect()
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, root).select("doc_id").collect()}
    toxic = [r["doc_id"] in kept for r in labels if r["toxic"]]
    clean = [r["doc_id"] in kept for r in labels if not r["toxic"]]
    assert sum(toxic) <= 0.2 * len(toxic) and sum(clean) >= 0.99 * len(clean)


def test_stages_take_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 2
        assert stage(spark, docs.limit(0), SF).count() == 0
