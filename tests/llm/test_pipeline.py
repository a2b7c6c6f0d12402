"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        counts.append(docs.count())
        assert after <= before
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "quality":
            assert len(after & bad) < 0.1 * len(bad) and len(after & good) > 0.98 * len(good)
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[5] == counts[4]


def test_stages_of_empty_and_odd_tables(spark, odd, none):
    data = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (none.select(*columns), odd.select(*columns), odd):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() <= 3 * odd.count()
