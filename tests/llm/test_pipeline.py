import corpus_pipeline
from tests.conftest import SF_SMALL
from tillroll.llm.shared import stored


def test_stages_one_after_the_other(spark):
    """Each stage keeps the columns, and its decisions hold in what it returns."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    last = seen["secret_scan"]
    assert last.where("n_chars <> length(text)").count() == 0
    assert last.where(r"text rlike 'AKIA[A-Z0-9]{12,}'").count() == 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, SF_SMALL).count() == docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), f"empty-{name}")
        assert docs.count() == 0
