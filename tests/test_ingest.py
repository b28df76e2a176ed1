import pytest
from pyspark.sql import functions as F

from sightline import schema
from sightline.sources import ingest, responses, tables


def test_csv_import_and_rejects(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("Quelle agence choisir ; ; seo, llm ; Non\n\n  best tool;en\r\nprix du web;fr;a\n")
    got = {r.text: r for r in ingest.import_prompts_csv(ingest.read_lines(spark, str(f))).collect()}
    assert (got["Quelle agence choisir"].lang, got["Quelle agence choisir"].tags, got["Quelle agence choisir"].web_search) == ("fr", ["seo", "llm"], False)
    assert (got["best tool"].lang, got["best tool"].web_search) == ("en", True) and len(got) == 3
    short = spark.createDataFrame([("abc",), ("long enough",)], "value string")
    with pytest.raises(Exception, match="too short"):
        ingest.import_prompts_csv(short).collect()
    assert [r.valid for r in ingest.import_prompts_csv(short, on_error="mark").orderBy("text").collect()] == [False, True]


def test_ingest_twice_changes_nothing(spark):
    kind = "run_id string, prompt_id int, engine_id string, repeat_index int, created_at int, result_id int"
    batch = spark.createDataFrame([("r", 1, "A", 0, 5, 10), ("r", 1, "A", 0, 4, 11), ("r", 2, "A", 0, 5, 12)], kind)
    first = ingest.ingest_results_idempotent(batch.limit(0), batch)
    assert {r.result_id for r in first.collect()} == {11, 12}
    assert ingest.ingest_results_idempotent(first, batch).count() == 0


def test_asof_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    req = [(rng.randint(0, 2), rng.randint(0, 20_000), i) for i in range(200)]
    old = [(rng.randint(0, 2), rng.randint(0, 20_000), i) for i in range(150)]

    def frame(rows, name):
        return spark.createDataFrame(rows, f"k int, s long, {name} int").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")

    got = {r.i: r.found_at for r in ingest.asof_within_ttl(frame(req, "i"), frame(old, "h"), "k", "t", "h", 10).collect()}
    for k, s, i in req:
        best = max((o[1] for o in old if o[0] == k and s - 600 <= o[1] <= s), default=None)
        assert (got[i] is None) == (best is None), i
        assert best is None or (got[i] - got[i].replace(hour=0, minute=0, second=0)).seconds == best % 86400


def test_responses_by_provider(spark):
    raw = [
        (1, "google", '{"sources":[{"sourceType":"url","url":"https://a.ca/1"}],"providerMetadata":{"google":{"groundingMetadata":{"webSearchQueries":["x"," x","y"],'
            '"groundingChunks":[{"web":{"uri":"https://a.ca/1"}},{"web":{"uri":"https://b.ca"}}],"groundingSupports":[{"groundingChunkIndices":[1]}]}}}}'),
        (2, "perplexity", '{"sources":[{"sourceType":"url","url":"https://a.ca"},{"sourceType":"url","url":"https://a.ca"}]}'),
        (3, "openai", "{}"),
    ]
    got = {r.result_id: r for r in responses.normalize_engine_responses(spark.createDataFrame(raw, "result_id int, provider string, response string")).collect()}
    assert [(s.url, s.cited) for s in got[1].sources] == [("https://a.ca/1", False), ("https://b.ca", False)]
    assert (got[1].search_queries, got[1].searches) == (["x", "y"], 1)
    assert [s.domain for s in got[2].sources] == ["a.ca"] and got[2].searches == 1
    assert got[3].sources == [] and got[3].searches == 0


def test_snapshot_copy_refuses_a_used_target(spark, tmp_path):
    row = spark.createDataFrame([("i", "p")], "id string, project_id string")
    full = row.select(*[(F.col(f.name) if f.name in ("id", "project_id") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.TABLES["inspections"].fields])
    target = str(tmp_path / "copy")
    assert tables.snapshot_copy(spark, {"inspections": full}, target) == ["inspections"]
    with pytest.raises(ValueError):
        tables.snapshot_copy(spark, {"inspections": full}, target)
    tables.snapshot_copy(spark, {"inspections": full}, target, force=True)
    assert tables.scan_table(spark, target, "inspections").count() == 1
    assert schema.outside_allowed(full.withColumn("status", F.lit("odd")), "status", ["done"]).count() == 1


def test_streams_equal_batch(spark, sf):
    from sightline.operators.runs import runs
    import sightline.plans.catalog_streams  # noqa: F401 (registers the jobs)
    from sightline.plans.catalog import QUERIES
    from sightline.sources.binding import AnswerLog

    batch = {(r.run_id, r.done_count, r.error_count, round(r.cost_usd, 6)) for r in runs(AnswerLog(spark, sf)).collect()}
    assert {(r.run_id, r.done_count, r.error_count, round(r.cost_usd, 6)) for r in QUERIES["stream_run_counters"](spark, sf).collect()} == batch
    assert QUERIES["stream_detect"](spark, sf).exceptAll(QUERIES["detect_rows"](spark, sf)).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
