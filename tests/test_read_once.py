"""Sources and hosts are read once by the queries that look at them from several sides."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import inspections as I
from sightline.operators import source_metrics as S
from sightline.operators.domains import with_owner
from sightline.sources.binding import AnswerLog


def scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet]")


@pytest.mark.parametrize("build, most", [(S.domains_instead, 1), (I.comparison_candidates, 2), (I.answer_flags, 2)])
def test_scans_of_the_sources(spark, sf, build, most):
    assert 0 < scans(build(AnswerLog(spark, sf)), "lineitem") <= most


def test_first_owner_of_every_host(spark):
    entities = spark.createDataFrame(
        [("P", 1, "brand", 0, "Own", ["own.ca"]), ("P", 2, "competitor", 1, "Rival", ["own.ca", "rival.com"]), ("Q", 3, "brand", 0, "Other", [" "])],
        "project_id string, entity_id long, entity_type string, ordinal int, name string, domains array<string>",
    )
    hosts = [("P", "own.ca", 1), ("P", "a.b.rival.com", 2), ("P", "notown.ca", 3), ("P", "", 4), ("P", None, 5), (None, "own.ca", 6), ("Q", "own.ca", 7)]
    df = spark.createDataFrame(hosts, "project_id string, domain string, n int")
    got = {r.n: r for r in with_owner(df, entities, ["domain"]).collect()}
    assert [(got[n].project_id, got[n].domain) for n in sorted(got)] == [h[:2] for h in hosts]
    assert {n: r.owner_name for n, r in got.items() if r.owner_name} == {1: "Own", 2: "Rival"}
    assert (got[1].owner_type, got[1].owner_id, got[3].owner_type) == ("brand", 1, None)


def test_candidates_leave_out_own_pages_the_target_and_answers_that_cite_it(spark):
    class Log:
        pass

    log = Log()
    log.entities = spark.createDataFrame(
        [("P", 1, "brand", 0, "Own", ["own.ca"])], "project_id string, entity_id long, entity_type string, ordinal int, name string, domains array<string>"
    )
    log.inspections = spark.createDataFrame([("I", "https://own.ca/x")], "inspection_id string, url string")
    answers = [("I", "P", 0, "A", 1, None), ("I", "P", 1, "A", 2, None), ("I", "P", 2, "B", 3, None), ("I", "P", 3, "B", 4, "err")]
    log.inspection_answers = spark.createDataFrame(
        answers, "inspection_id string, project_id string, question_index int, engine_id string, result_id long, error string"
    )
    source = lambda result, rank, cited, domain, path: (result, rank, rank if cited else None, cited, domain, f"http://www.{domain}/{path}/")
    ranked = [
        source(1, 1, True, "own.ca", "x"), source(1, 2, True, "t.com", "p"),  # cites the target
        source(2, 1, False, "own.ca", "x"), source(2, 2, True, "blog.own.ca", "y"), source(2, 3, True, "t.com", "p"), source(2, 4, False, "u.com", "q"),
        source(3, 1, True, "t.com", "p"), source(3, 2, True, "v.com", "r"), source(4, 1, True, "w.com", "s"),
    ]
    rows = spark.createDataFrame(ranked, "result_id long, rank long, cited_rank long, cited boolean, domain string, url string")
    log.inspection_ranked_of = lambda answers: rows.join(answers.select("result_id"), "result_id", "left_semi")
    got = [(r.page, r.questions, r.engines) for r in I.comparison_candidates(log).orderBy("rank").collect()]
    assert got == [("t.com/p", 2, "A,B"), ("v.com/r", 1, "B")]
    flags = {r.result_id: (r.url_cited, r.url_retrieved, r.domain_cited, r.domain_rank) for r in I.answer_flags(log).collect()}
    assert flags == {1: (True, True, True, 1), 2: (False, True, True, 2), 3: (False, False, False, None), 4: (False, False, False, None)}
