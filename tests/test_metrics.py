import pytest
from answer_fixture import YESTERDAY, answer_log, rows
from pyspark.sql import functions as F

from sightline.operators import answers as A
from sightline.operators import details as X
from sightline.operators import inspections as I
from sightline.operators import ranks as N
from sightline.operators import runs as R
from sightline.operators import source_metrics as S


@pytest.fixture(scope="module")
def log(spark):
    return answer_log(spark)


def by(df, *keys, project="P"):
    if "project_id" in df.columns and project:
        df = df.filter(F.col("project_id") == project)
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_engine_cards(log):
    e = by(A.engine_cards(log), "engine_id")
    assert (e["A"].answers, e["A"].citation_rate, e["A"].mention_rate) == (4, 0.5, 0.5)
    assert e["A"].citation_delta == 50
    assert e["A"].cost_eur == pytest.approx(0.05 * 0.92)
    assert (e["B"].answers, e["B"].citation_rate, e["B"].mention_rate, e["B"].citation_delta) == (2, 0.0, 0.5, None)


def test_share_of_voice(log):
    s = by(A.share_of_voice(log), "name")
    assert (s["Brandlab"].answers, s["Brandlab"].cited, s["Brandlab"].mentioned, s["Brandlab"].share) == (6, 2, 3, 0.5)
    assert s["Brandlab"].citation_delta == pytest.approx(33.333, abs=0.01)
    assert (s["Digit"].cited, s["Digit"].mentioned, s["Digit"].prompt_count) == (2, 2, 1)


def test_theme_matrix_and_summary(log):
    m = by(A.engine_theme_matrix(log), "theme", "engine_id")
    assert tuple(m["seo", "A"])[-3:] == (3, 2, 2)
    assert tuple(m["seo", "B"])[-3:] == (2, 0, 1)
    t = by(A.theme_summary(log), "theme")
    assert (t["seo"].prompt_count, t["seo"].answers, t["seo"].citation_rate, t["seo"].mention_rate) == (2, 5, 0.4, 0.6)
    order = by(A.theme_summary_ordered(log), "theme")
    assert order["Sans thème"].position == len(order)


def test_engine_domains(log):
    d = by(S.engine_domains(log), "engine_id", "domain")
    assert (d["A", "clutch.co"]["count"], d["A", "brandlab.ca"]["count"], d["A", "digit.ca"]["count"]) == (2, 2, 1)
    assert d["A", "brandlab.ca"].owner_type == "brand" and d["A", "clutch.co"].owner_type is None


def test_engine_stats(log):
    e = by(A.engine_stats(log), "engine_id")
    assert (e["A"].median_latency_ms, e["A"].avg_sources, e["A"].with_sources_rate) == (850, 1.25, 0.75)
    assert (e["B"].errors, e["B"].median_latency_ms) == (1, 2500)


def test_domains_instead(log):
    d = by(S.domains_instead(log), "domain")
    assert (d["clutch.co"].answers, d["clutch.co"].without_brand, d["clutch.co"].brand_present) == (3, 2, True)
    assert (d["digit.ca"].answers, d["digit.ca"].without_brand, d["digit.ca"].brand_present) == (2, 2, False)


def test_brand_pages_join_spellings(log):
    p = S.brand_pages(log).filter("project_id = 'P'").collect()
    assert [(x.page, x["count"], x.prompt_count) for x in p] == [("brandlab.ca/seo", 2, 1)]
    c = S.brand_page_citations(log).filter("project_id = 'P'").collect()
    assert {(x.result_id, x["rank"], x.cited) for x in c} == {("r1", 1, True), ("r2", 1, True)}


def test_prompts_without_brand(log):
    p = by(A.prompts_without_brand(log), "prompt_id")
    assert set(p) == {"p2", "p3"}
    assert (p["p2"].competitors, p["p3"].competitors) == ("Digit", "")


def test_opportunities_and_overlap(log):
    o = by(A.quick_opportunities(log), "prompt_id")
    assert set(o) == {"p2"} and (o["p2"].answers, o["p2"].competitors) == (2, "Digit:2")
    v = by(A.competitor_overlap(log), "prompt_id")
    assert v["p2"].answers == 2
    g = by(S.competitor_pages(log), "page")
    assert g["digit.ca/seo"]["count"] == 2


def test_prompt_history_and_scorecard(log):
    h = by(A.prompt_history(log), "result_id")
    assert (h["r1"].status, h["r3"].status, h["r6"].status, h["r7"].status) == ("cited", "mentioned", "none", "error")
    assert h["r4"].competitors == "Digit" and h["r4"].sources_count == 2
    s = by(A.prompt_scorecard(log), "prompt_id")
    assert (s["p2"].ok, s["p2"].cited, s["p2"].rivals) == (2, 0, 1)
    c = by(A.prompt_competitors(log), "prompt_id")
    assert (c["p2"].cited, c["p2"].mentioned, c["p2"].answers) == (2, 2, 2)
    assert (c["p3"].cited, c["p3"].answers) == (0, 1)


def test_shares_sum_to_one_and_rates_stay_in_range(log):
    s = A.share_of_voice(log).groupBy("project_id").agg(F.sum("share").alias("s"), F.max("citation_rate").alias("r")).collect()
    assert all(x.s == pytest.approx(1) and 0 <= x.r <= 1 for x in s)


def test_latest_cell_ignores_the_period(log):
    m = by(A.prompt_matrix(log), "prompt_id", "engine_id")
    assert m["p3", "B"].status == "error" and m["p1", "A"].result_id == "r1"
    assert m["p1", "A"].citation_rate == pytest.approx(2 / 3)


def test_plan_takes_turns_and_respects_modes(log):
    tasks = R.plan_tasks(log).filter("project_id = 'P'").collect()
    assert len(tasks) == 8 and max(x.turn for x in tasks) == 4
    order = sorted((x.turn, x.prompt_id, x.repeat_index) for x in tasks if x.engine_id == "A")
    assert order == [(1, "p1", 0), (2, "p1", 1), (3, "p2", 0), (4, "p2", 1)]
    assert {x.prompt_id for x in R.remaining_tasks(log).collect()} == {"p1", "p2", "q1"}


def test_runs_come_from_their_table(log):
    r = by(R.runs(log), "run_id", project=None)
    assert (r["run1"].status, r["run1"].started_at, r["run1"].done_count, r["run1"].error_count) == ("done", YESTERDAY, 8, 1)
    assert r["run1"].cost_usd == pytest.approx(0.09)
    assert by(R.run_duration(log), "run_id", project=None)["run1"].duration_ms is None
    assert [x.run_id for x in R.runs_recent(log).filter("project_id = 'P'").collect()] == ["run1"]


def test_run_outcome_with_string_ids(log, spark):
    empty = rows(spark, "runs", [{"id": "run3", "project_id": "P", "status": "done", "started_at": YESTERDAY}])
    more = type(log)({**log.tables, "runs": log.tables["runs"].unionByName(empty)}, log.as_of, log.days)
    o = by(R.run_outcome(more), "run_id", project=None)
    assert (o["run1"].status, o["run1"].done, o["run3"].status, o["run3"].done) == ("done", 8, "failed", 0)


def test_prices_of_an_engine_come_first(log, spark):
    used = log.tables["results"].withColumn("usage", F.expr("named_struct('input_tokens', 1000000L, 'output_tokens', 0L, 'total_tokens', 0L, 'searches', 2L)"))
    own = F.expr("named_struct('input_per_mtok', 7.0D, 'output_per_mtok', 0.0D, 'per_search', 0.5D)")
    engines = log.tables["engines"].withColumn("pricing", F.when(F.col("id") == "A", own))
    c = by(R.answer_cost(type(log)({**log.tables, "results": used, "engines": engines}, log.as_of, log.days)), "result_id", project=None)
    assert c["r1"].cost_usd == pytest.approx(8.0) and c["r3"].cost_usd == pytest.approx(1.016)


def test_matrix_holds_prompts_without_answers(log, spark):
    silent = rows(spark, "prompts", [{"id": "p0", "project_id": "P", "text": "never asked", "tags": [], "web_search": True, "active": True, "created_at": YESTERDAY}])
    more = type(log)({**log.tables, "prompts": log.tables["prompts"].unionByName(silent)}, log.as_of, log.days)
    m = [(x.position, x.prompt_id, x.engine_id) for x in A.prompt_matrix(more).filter("project_id = 'P'").collect()]
    assert min(m) == (1, "p0", None) and {x[1] for x in m} == {"p0", "p1", "p2", "p3"}
    assert max(m)[1] == "p3"  # inactive ones last


def test_month_starts_in_the_zone(log):
    row = log.projects.limit(1).select(A.month_start(F.lit("2026-03-01 00:30:00").cast("timestamp_ntz"), "America/Toronto").alias("m")).first()
    assert str(row.m) == "2026-02-01 05:00:00"


def test_stored_detections_are_read(log):
    stored = log.detections.withColumn("cited", F.lit(False)).withColumn("mentioned", F.lit(False))
    quiet = type(log)({**log.tables, "detections": stored}, log.as_of, log.days)
    assert by(A.brand_rates(quiet), "project_id")["P"].cited == 0 and by(A.brand_rates(log), "project_id")["P"].cited == 2


def test_details_are_nested(log):
    d = {r.result_id: r for r in X.result_detail(log, log.results.filter("result_id = 'r1'")).collect()}
    assert set(d) == {"r1"} and d["r1"].prompt.text == "best agency" and d["r1"].run.status == "done"
    assert [(x.entity_type, x.cited) for x in d["r1"].detections] == [("brand", True), ("competitor", False)]
    assert [e.name for e in d["r1"].entities] == ["Brandlab", "Digit"]
    assert by(X.nested_detail(log), "project_id")["P"].competitors[0].name == "Digit"
    i = by(X.inspection_detail(log, I.answer_flags(log)), "inspection_id")
    assert [a.result_id for a in i["I1"].answers] == ["a1", "a2", "a3", "a4"] and i["I2"].answers is None
    assert [r.inspection_id for r in X.list_inspections(log).filter("project_id = 'P'").orderBy("position").collect()] == ["I1", "I2"]
    assert {r.prompt_id for r in X.prompt_search(log, text="AGENCY", tag="llm").collect()} == {"p2"}
    assert {r.prompt_id for r in X.prompt_search(log, active=False).collect()} == {"p3"}


def test_ranks_and_intervals(log, spark):
    w = by(N.wilson_interval(log), "project_id")["P"]
    assert w.citation_rate == pytest.approx(1 / 3) and w.citation_low == pytest.approx(0.0968, abs=1e-3) and w.citation_high == pytest.approx(0.7, abs=1e-2)
    m = by(N.mean_citation_rank(log), "name")
    assert (m["Brandlab"].cited, m["Brandlab"].mean_rank, m["Digit"].mean_rank) == (2, 1.0, 1.0)
    assert by(N.brand_rank_among_domains(log), "domain")["brandlab.ca"].place == 2
    t = by(N.taken_by(log), "prompt_id", "domain")
    assert (t["p2", "digit.ca"].answers, t["p2", "digit.ca"].owner_name, t["p1", "clutch.co"].answers) == (2, "Digit", 1)
    d = by(N.competitor_duel(log), "name")["Digit"]
    assert (d.both, d.rival_only, d.brand_only, d.neither) == (0, 2, 2, 2)
    pages = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "page string, faq boolean")
    cited = spark.createDataFrame([("a", "E", True), ("b", "E", False), ("c", "E", False)], "page string, engine_id string, cited boolean")
    c = by(N.signal_calibration(pages, cited, ["faq"]), "has_signal", project=None)
    assert (c[True].n, c[True].cited_share, c[False].cited_share) == (2, 0.5, 0.0)


def test_inspection_flags_and_verdict(log):
    f = by(I.answer_flags(log), "result_id", project=None)
    assert (f["a1"].url_cited, f["a1"].url_rank, f["a1"].domain_rank) == (True, 2, 2)
    assert (f["a2"].url_cited, f["a2"].domain_cited) == (False, True)
    assert (f["a3"].url_cited, f["a3"].url_retrieved, f["a3"].domain_cited) == (False, True, False)
    v = by(I.verdict(log), "inspection_id", project=None)["I1"]
    assert (v.ok, v.url_cited, v.domain_only, v.competitor_only, v.errors) == (3, 1, 1, 1, 1)
    s = by(I.inspection_summaries(log), "inspection_id", project=None)
    assert (s["I1"].ok, s["I1"].url_cited, s["I1"].domain_cited, s["I2"].ok) == (3, 1, 1, 0)


def test_result_score_is_the_mean_of_engine_means(log):
    e = by(I.result_per_engine(log), "engine_id", project=None)
    assert (e["A"].value, e["B"].value) == (pytest.approx(0.7), pytest.approx(0.6))
    r = I.result_score(log).collect()[0]
    assert (r.result, r.confidence) == (26, "low")


def test_inspection_costs_and_quota(log):
    since = F.lit("2026-09-01").cast("timestamp_ntz")
    assert I.inspections_cost_since(log, since).collect()[0].cost_usd == pytest.approx(0.12)
    q = by(I.inspection_quota(log, since), "project_id", project=None)
    assert (q["P"].running, q["P"].allowed, q["Q"].allowed) == (1, False, True)


def test_url_history_ranks(log, spark):
    h = S.url_history(log, spark.createDataFrame([("P", "http://brandlab.ca/seo")], "project_id string, url string")).collect()
    assert {(x.result_id, x["rank"]) for x in h} == {("r1", 1), ("r2", 1)}
