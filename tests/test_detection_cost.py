"""Detection numbers, looks up and groups the sources of answers with as little work as they need."""

from collections import Counter

from pyspark.sql import functions as F

from sightline.functions.urls import host_suffixes
from sightline.operators.detect import detections, first_ranks
from sightline.operators.domains import all_owners, tracked_domains
from sightline.operators.windows import ordinal
from sightline.sources.binding import AnswerLog

ENTITY = "project_id string, entity_id long, entity_type string, ordinal int, name string, terms array<string>, domains array<string>"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_rows_beside_the_rows_of_their_key(spark):
    """A key that comes twice gets its rows twice, numbered once; keys without rows, null keys and rows of other keys have none."""
    rows = [(k, s, i, i % 3 > 0) for k in (1, 2, 3, None) for s in (0, 1, 2) for i in range(s * 10, s * 10 + k if k else s * 10 + 2)]
    df = spark.createDataFrame(rows, "k long, s int, o int, f boolean").repartition(5)
    of = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "d"), (None, "e")], "k long, p string")
    beside = ordinal(df, ["k"], ["o"], "n", [F.col("s")], flag="f", flag_out="m", of=of)
    after = ordinal(df, ["k"], ["o"], "n", [F.col("s")], flag="f", flag_out="m").join(of, "k")
    found = lambda d: sorted(map(str, d.select("k", "p", "o", "n", "m").collect()))
    assert found(beside) == found(after) and len(found(beside)) == 3 + 2 * 6
    assert sorted(r.n for r in beside.where("p = 'c'").collect()) == [1, 2, 3, 4, 5, 6]


def test_owners_of_hosts_of_any_depth(spark):
    entities = spark.createDataFrame(
        [
            ("P", 1, "brand", 0, "A", ["A"], ["own.ca", "shop.own.ca", "ca"]), ("P", 2, "competitor", 1, "B", ["B"], ["own.ca", "own.ca", "", None]),
            ("Q", 3, "brand", 0, "C", ["C"], ["localhost", "a..b"]), ("R", 4, "brand", 0, "D", ["D"], []),
        ],
        ENTITY,
    )
    names = ["own.ca", "x.shop.own.ca", "notown.ca", "ca", "localhost", "x.a..b", "a.b", ".", "", "own.ca.", None, "a.b.c.d.e.f.own.ca"]
    hosts = spark.createDataFrame([(p, n, i) for p in ("P", "Q", "R", None) for i, n in enumerate(names)] + [("P", "own.ca", 0)], "project_id string, domain string, n int")
    tracked = [(r.project_id, r.suffix, r.entity_id) for r in tracked_domains(entities).collect()]
    cut = hosts.select("*", host_suffixes(F.col("domain")).alias("s")).collect()
    want = Counter((h.project_id, h.n, e) for h in cut for p, s, e in tracked if p == h.project_id for x in h.s or [] if x == s)
    owned = all_owners(hosts, entities)
    assert Counter((r.project_id, r.n, r.entity_id) for r in owned.collect()) == want and max(want.values()) > 1
    assert owned.columns[:3] == ["project_id", "domain", "n"] and "sequence(" not in optimized(owned)


def test_ranks_of_sources_that_have_their_project(spark):
    entities = spark.createDataFrame([("P", 1, "brand", 0, "A", ["A"], ["own.ca"]), ("Q", 2, "brand", 0, "B", ["B"], ["own.ca"])], ENTITY)
    answers = spark.createDataFrame([(1, "P"), (1, "Q"), (2, "P"), (2, "P"), (3, "P")], "result_id long, project_id string")
    ranked = spark.createDataFrame(
        [(1, "x.ca", 1, 1), (1, "a.own.ca", 2, None), (1, "own.ca", 3, 2), (2, "own.ca", 1, None), (4, "own.ca", 1, 1)],
        "result_id long, domain string, rank long, cited_rank long",
    )
    rows = lambda df: sorted(map(str, df.collect()))
    apart = first_ranks(answers, ranked, entities)
    assert rows(first_ranks(answers, ranked.join(answers, "result_id"), entities)) == rows(apart)
    assert {(r.result_id, r.entity_id): (r.citation_rank, r.retrieved_rank) for r in apart.collect()} == {(1, 1): (2, 2), (1, 2): (2, 2), (2, 1): (None, 1)}
    assert optimized(apart).count("Aggregate [result_id") == 1  # grouped once, when only sources with an owner are left


def test_all_answers_need_no_lookup_of_their_sources(spark, sf):
    log = AnswerLog(spark, sf)
    at_once = log.detected(log.entities)
    apart = detections(log.results, log.ranked_of(log.results), log.texts_of(log.results), log.entities)
    assert optimized(at_once).count("Join LeftSemi") == 1 < optimized(apart).count("Join LeftSemi")  # texts only
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(at_once) == rows(apart)
    some = log.results.where("project_id = 'BUILDING'")
    assert rows(log.detected(log.entities, some)) == rows(apart.where("project_id = 'BUILDING'"))
