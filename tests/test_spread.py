import re

from pyspark.sql import functions as F

from sightline.operators.detect import mention_pairs
from sightline.sources.responses import resolve_source_redirects
from sightline.sources.snapshots import OPEN_FILES, Snapshots

REDIRECT = "https://vertexaisearch.cloud.google.com/grounding-api-redirect/"


def redirects(spark):
    pos = "struct<n:int>"
    rows = [
        (1, (1,), "https://a.example/x", "t", "a.example"), (1, (2,), REDIRECT + "1", "b.example", "g"), (1, (3,), REDIRECT + "2", "c.example", "g"),
        (2, (1,), None, "t", "d.example"), (None, (1,), "https://a.example/x", "t", "a.example"), (2, (2,), REDIRECT + "1", "no host", "g"),
    ]
    sources = spark.createDataFrame(rows, f"result_id long, pos {pos}, url string, title string, domain string")
    known = spark.createDataFrame([(REDIRECT + "1", "https://www.r.example/p"), (REDIRECT + "2", None), (None, "https://x.example")], "url string, location string")
    return resolve_source_redirects(sources, known)


def test_redirects_and_plain_sources(spark):
    found = {(r.result_id, r.url, r.domain) for r in redirects(spark).collect()}
    assert found == {
        (1, "https://a.example/x", "a.example"), (1, "https://www.r.example/p", "r.example"), (1, REDIRECT + "2", "c.example"),
        (2, None, "d.example"), (None, "https://a.example/x", "a.example"), (2, "https://www.r.example/p", "r.example"),
    }


def test_sources_without_redirect_do_not_meet_in_one_task(spark):
    shown = redirects(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, .*_spread", shown)


def test_texts_are_normalised_once_per_use(spark):
    answers = spark.createDataFrame([(1, "p")], "result_id long, project_id string")
    texts = spark.createDataFrame([(1, "Acme and more")], "result_id long, raw_text string")
    entities = spark.createDataFrame(
        [("p", 1, "brand", 0, ["Acme"], ["acme.example"])],
        "project_id string, entity_id long, entity_type string, ordinal int, terms array<string>, domains array<string>",
    )
    pairs = mention_pairs(answers, texts, entities)
    assert [(r.first_index, r.matched_terms) for r in pairs.collect()] == [(0, ["Acme"])]
    lines = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "raw_text" in x and "translate" in x]
    assert len(lines) == 2  # for the index and for the test on the text; not in filters as well


def test_slices_are_written_without_a_setting_left_behind(spark, tmp_path):
    before = spark.conf.get(OPEN_FILES, "0")
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], 4)
    table.write(spark.range(100).withColumn("k", F.col("id") % 7))
    assert table.read().count() == 100 and spark.conf.get(OPEN_FILES, "0") == before
