import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import detect as D
from sightline.operators import windows as X
from sightline.sources.binding import AnswerLog
from sightline.sources.log import TableLog

from answer_fixture import answer_log

ENTITIES = [
    ("P", 1, "brand", 0, "Nimbo", ["Nimbo", "Nimbo City"], ["nimbo.city"]),
    ("P", 2, "competitor", 1, "Félix", ["Félix"], ["felix.com"]),
    ("P", 3, "competitor", 2, "Mia", ["Mia"], ["mia.fr"]),
]
ENTITY_TYPE = "project_id string, entity_id long, entity_type string, ordinal int, name string, terms array<string>, domains array<string>"
ANSWER_TYPE = "result_id long, project_id string, raw_text string, sources array<struct<url:string,cited:boolean>>, error string"
ANSWERS = [
    (1, "P", "felix then Nimbo City, not Miami", [("https://blog.nimbo.city/a", None), ("https://www.felix.com", True)], None),
    (2, "P", "see mia.fr", [("https://notnimbo.city", True), ("https://felix.com", False), ("https://nimbo.city:443/x", True)], None),
    (3, "P", "nothing", [], None),
    (4, "P", "Nimbo", [("https://nimbo.city", True)], "timeout"),
]


def verdicts(df):
    return {
        (r.result_id, r.entity_id): (r.citation_rank, r.retrieved_rank, r.mention_rank, list(r.matched_terms)) for r in df.collect()
    }


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ANSWERS, ANSWER_TYPE), spark.createDataFrame(ENTITIES, ENTITY_TYPE)


WANT = {
    (1, 1): (1, 1, 2, ["Nimbo", "Nimbo City"]), (1, 2): (2, 2, 1, ["Félix"]), (1, 3): (None, None, None, []),
    (2, 1): (2, 3, None, []), (2, 2): (None, 2, None, []), (2, 3): (None, None, 1, ["Mia"]),
    (3, 1): (None, None, None, []), (3, 2): (None, None, None, []), (3, 3): (None, None, None, []),
}


def test_detect_rows(tables):
    assert verdicts(D.detect_rows(*tables)) == WANT


def test_joined_detection_equals_the_row_form(tables):
    answers, entities = tables
    ranked = TableLog._unnested(
        answers.select(F.col("result_id").alias("id"), F.transform("sources", lambda s: F.struct(s["url"].alias("url"), F.lit(None).cast("string").alias("domain"), s["cited"].alias("cited"))).alias("sources"))
    )
    got = D.detections(answers, ranked, answers.select("result_id", "raw_text"), entities)
    assert verdicts(got) == WANT


def test_domain_counts_only_without_a_term(spark):
    e = spark.createDataFrame([("P", 1, "brand", 0, "Zed", ["Zed"], ["zed.io", ""])], ENTITY_TYPE)
    a = spark.createDataFrame([(1, "P", "go to zed.io", [], None), (2, "P", "at azed.ios", [], None)], ANSWER_TYPE)
    got = verdicts(D.detect_rows(a, e))
    assert got[(1, 1)][3] == ["Zed"] and got[(2, 1)][3] == ["zed.io"]


def test_mention_spans(spark):
    df = spark.createDataFrame([("Le café CAFE et cafés 😀 café", ["Café", "le café"])], "t string, w array<string>")
    s = df.select(D.mention_spans("t", "w").alias("s")).collect()[0].s
    # A term that ends in an accent also matches before a further letter: the mark may stay outside the match.
    assert [(x.start, x.end, x.term) for x in s] == [(0, 7, "le café"), (3, 7, "Café"), (8, 12, "Café"), (16, 20, "Café"), (25, 29, "Café")]


def test_ordinal_counts_rows_and_flagged_rows(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50 + 2).alias("k"), (F.col("id") * 7919 % 4001).alias("o"), (F.col("id") % 3 == 0).alias("f")
    )
    split = X.ordinal(df, ["k"], ["o"], "n", [F.floor(F.col("o") / 100)], flag="f", flag_out="m")
    want, seen = [], {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        n, m = seen.get(r.k, (0, 0))
        seen[r.k] = (n + 1, m + r.f)
        want.append((r.k, r.o, r.f, n + 1, m + 1 if r.f else None))
    assert sorted(map(tuple, split.collect()), key=lambda r: r[1]) == want


def test_exact_median(spark):
    pdf = pd.DataFrame({"k": [1] * 5 + [2] * 4, "v": [5, 1, 9, 9, 2, 1, 2, 3, 10]})
    got = {r.k: r.m for r in X.exact_median(spark.createDataFrame(pdf), ["k"], "v", "m").collect()}
    assert got == {1: 5.0, 2: 2.5}


@pytest.mark.parametrize("kind", ["short", "int", "long", "double"])
def test_exact_median_of_unique_values(spark, kind):
    """A hot key of unique values, a null key, negative values and nulls; no task gets all values of a key."""
    import random
    import statistics

    rng = random.Random(3)
    spread = {"short": 2**15 - 1, "int": 2**31 - 1, "long": 2**52, "double": 1e9}[kind]
    one = (lambda: rng.uniform(-spread, spread)) if kind == "double" else (lambda: rng.randint(-spread, spread))
    rows = [(1, "e", one()) for _ in range(5001)] + [(1, "e", None)] + [(2, None, one()) for _ in range(4)] + [(3, "e", 7 if kind != "double" else -0.5)] * 6 + [(4, "e", None)]
    df = spark.createDataFrame(rows, f"p int, e string, v {kind}")
    found = X.exact_median(df, ["p", "e"], "v", "m")
    want = {k: statistics.median(v for p, _, v in rows if p == k and v is not None) for k in (1, 2, 3)}
    assert {r.p: r.m for r in found.collect()} == pytest.approx(want, abs=1e-6)
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_prompts_are_listed_in_order(spark):
    """Active first, newest first, ties by id; unknown activity and time last."""
    from types import SimpleNamespace

    import sightline.operators.answers as A

    rows = [(1, i, [True, False, None][i % 3], None if i % 7 == 0 else f"2026-0{1 + i % 4}-1{i % 5} 0{i % 3}:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "project_id int, prompt_id int, active boolean, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.prompt_id: r.position for r in A.prompt_positions(SimpleNamespace(prompts=df)).collect()}
    newest = sorted(rows, key=lambda r: r[1])
    newest.sort(key=lambda r: r[3] or "", reverse=True)
    newest.sort(key=lambda r: {True: 0, False: 1, None: 2}[r[2]])
    assert got == {r[1]: n for n, r in enumerate(newest, 1)}


def test_binding_detections_equal_brute_force(spark, sf):
    """Plain Python over every answer of the smallest tables, with the list form of the detection."""
    log = AnswerLog(spark, sf)
    got = D.detections(log.results, log.ranked_of(log.results), log.texts_of(log.results), log.entities)
    s = log.ranked_of(log.results).select("result_id", "rank", F.struct("url", "cited").alias("s")).groupBy("result_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("sources")
    )
    listed = log.results.join(s, "result_id", "left").join(log.texts_of(log.results), "result_id", "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    listed = listed.withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<url:string,cited:boolean>>")))
    assert verdicts(got) == verdicts(D.detect_rows(listed, log.entities))


def test_recompute_replaces_one_project(spark, tmp_path):
    path = str(tmp_path / "d")
    a = spark.createDataFrame([("P", 1), ("Q", 2)], "project_id string, x int")
    D.recompute_detections(a, path)
    D.recompute_detections(spark.createDataFrame([("P", 9)], "project_id string, x int"), path)
    assert sorted((r.project_id, r.x) for r in spark.read.parquet(path).collect()) == [("P", 9), ("Q", 2)]


def test_table_log_detections(spark):
    log: TableLog = answer_log(spark)
    got = D.detections(log.results, log.ranked_of(log.results), log.texts_of(log.results), log.entities)
    assert got.filter("entity_type = 'brand' and cited and project_id = 'P'").count() == 2
