import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sightline.llm import decontaminate, packing, quality
from tests.llm.test_lines import brute as lines_brute
from tests.llm.test_setjoin import brute as join_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
    return [*out, docs]


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
        assert df.where(F.length("text") != F.col("n_chars")).count() == 0


def test_each_stage_as_brute_force(spark, outputs):
    source, good, lines, joined, clean, packed = outputs
    keep = {r["doc_id"] for r in quality.classify(source, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert rows(good) == [r for r in rows(source) if r[0] in keep]
    left = [(i, t) for (i, t), (_, old) in zip(lines_brute(rows(good), 3), rows(good))]
    texts = dict(rows(good))
    assert rows(lines) == [(i, t) for i, t in left if t or not texts[i]]
    least = {i for i, _, c in join_brute(rows(lines), 5, 80) if i == c}
    assert rows(joined) == [r for r in rows(lines) if r[0] in least]
    bad = {r["doc_id"] for r in decontaminate.contaminated(joined, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and rows(clean) == [r for r in rows(joined) if r[0] not in bad]
    n = {r["doc_id"]: r["n_tokens"] for r in packing.word_counts(clean).collect()}
    assert n == {i: len(t.split()) for i, t in rows(clean)} == packed.toPandas().groupby("doc_id").n_tokens.sum().to_dict()


def test_run_gives_the_last_stage(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs[-1].count()
