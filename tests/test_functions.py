import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions import dates, pricing, text, urls


def evaluate(spark, values, **exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.asDict() for r in df.select("i", *[e.alias(n) for n, e in exprs.items()]).orderBy("i").collect()]


def column(spark, values, expr):
    return [r["x"] for r in evaluate(spark, values, x=expr)]


V = F.col("v")


def test_normalize_text(spark):
    cases = ["Éléphant  Ça\tva", "Straße Œuvre", "ñ é", "ĳ ŵ"]
    want = [re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")).lower()) for s in cases]
    assert column(spark, cases, text.normalize_text(V)) == want


def test_terms_need_word_edges(spark):
    got = column(spark, ["nation_10 and nation_1", "my nation_1.", "nation_10", "c++ rocks"], text.find_term(V, F.lit("NATION_1")))
    assert got == [14, 3, -1, -1]
    assert column(spark, ["c++ rocks", "abc++"], text.find_term(V, F.lit("C++"))) == [0, -1]


def test_urls(spark):
    u = ["https://www.Site.ca/Blog/Seo/?utm_source=x&b=2&a=1#t", "http://site.ca:80", "mailto:a@b.c", "https://x.ca/a?q=d%C3%A9j%C3%A0+vu"]
    assert column(spark, u, urls.normalize_url(V)) == ["site.ca/Blog/Seo?a=1&b=2", "site.ca", None, "x.ca/a?q=d%C3%A9j%C3%A0%20vu"]
    assert column(spark, ["blog.nimbo.city", "notnimbo.city", "NIMBO.city"], urls.domain_matches(V, F.lit("nimbo.city"))) == [True, False, True]
    assert column(spark, ["https://fr.x.ca/a", "https://ax.ca/"], urls.same_site(V, F.lit("x.ca"))) == [True, False]
    assert column(spark, ["www.a.co.uk", "a.b.gouv.qc.ca", "x.y.com", "x.com"], urls.root_domain(V)) == ["a.co.uk", "gouv.qc.ca", "y.com", "x.com"]
    assert column(spark, ["agencies.semrush.com", "mylittlebigweb.com", "x.com.au"], urls.name_from_domain(V)) == ["Semrush", "Mylittlebigweb", "X"]
    got = column(spark, ["/a", "b", "//c.ca/d", "?x=1", "https://e.ca"], urls.resolve_url(V, F.lit("https://s.ca/p/q")))
    assert got == ["https://s.ca/a", "https://s.ca/p/b", "https://c.ca/d", "https://s.ca/p/q?x=1", "https://e.ca"]


def test_dates(spark):
    d = ["2026-03-12T10:00", "12 mars 2026", "1er février 2026", "March 12, 2026", "12/03/2026", "33/03/2026", "mars 2026"]
    assert column(spark, d, dates.parse_written_date(V)) == ["2026-03-12", "2026-03-12", "2026-02-01", "2026-03-12", "2026-03-12", None, None]
    assert column(spark, ["03/04/2026", "13/04/2026"], dates.parse_written_date(V, "en")) == ["2026-03-04", "2026-04-13"]
    now = F.lit("2026-09-08 12:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    assert column(spark, ["2026-03-08", "2027-01-01", "x"], dates.age_in_months(V, none, now)) == [6.1, 0.0, 60.0]
    r = evaluate(spark, ["2024-05-01", "x"], e=dates.effective_date(V, none, F.lit(2025), now))
    assert [x["e"].source for x in r] == ["année du titre", "année du titre"]
    days = spark.sql("select timestamp_ntz'2026-03-12 23:30:00' t").select(dates.local_day(F.col("t"))).collect()[0][0]
    assert days == "2026-03-13"


def test_headings_numbers_language(spark):
    h = ["Comment choisir ?", "1. Alphalab", "FAQ", "Le SEO est mort", "what is it", "Ouvrir", "Que faire"]
    assert column(spark, h, text.is_question_heading(V)) == [True, False, False, False, True, False, True]
    assert column(spark, h, text.is_entity_heading(V)) == [False, True, False, False, False, True, False]
    assert column(spark, ["500 $, 20 %, 12 mars 2026, 3 ans, 15 km", "rien"], text.count_numbers(V)) == [5, 0]
    fr = "le chat est dans la maison avec vous pour une nuit sur le lit"
    en = "the cat is in the house with you and the dog for a night on the bed"
    assert column(spark, [fr, en, "court"], text.guess_lang(V)) == ["fr", "en", ""]


def test_questions(spark):
    q = ["Quelle est la meilleure agence SEO à Montréal ?", "Combien coûte un site", "Quels outils", "Pourquoi faire", "Laval", "rien"]
    place = text.find_place(V)
    got = evaluate(spark, q, p=place, i=text.question_intent(V, place), k=text.key_terms(V))
    assert [g["i"] for g in got] == ["comparative", "price", "resource", "informational", "local", "informational"]
    assert [g["p"] for g in got] == ["Montréal", None, None, None, "Laval", None]
    assert got[0]["k"] == ["agence", "seo", "montreal"]
    assert column(spark, ["Quebec City ou Québec"], place) == ["Quebec City"]


def test_prices(spark):
    p = pricing.price_of(V, F.lit("google"))
    got = column(spark, ["gpt-5.4-mini", "unknown"], pricing.estimate_cost(p, F.lit(1_000_000), F.lit(1_000_000), F.lit(2)))
    assert got == [pytest.approx(5.27), pytest.approx(4.528)]


@pytest.mark.parametrize("pattern", ["PRICE_INTENT", "RESOURCE_INTENT", "COMPARATIVE_INTENT", "INFORMATIONAL_INTENT"])
def test_intent_patterns_agree_with_a_second_engine(spark, pattern):
    """The same pattern in Python, over every known wording, whole and cut."""
    words = [w for w in re.split(r"[|()?:]+", getattr(K, pattern)) if w.isalpha()]
    samples = words + [w[:-1] for w in words] + [f"x {w} y" for w in words]
    want = [re.search(getattr(K, pattern), s, re.A) is not None for s in samples]
    assert column(spark, samples, text.matches(V, getattr(K, pattern))) == want


def test_host_suffixes_are_cut_without_rebuilding_labels(spark):
    hosts = ["a.b.c", "host", "", "a..b", "end.", ".start", "é.example", None]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.host_suffixes(F.col("h")).alias("s"))
    found = {r.h: r.s for r in df.collect()}
    for h in hosts[:-1]:
        labels = h.split(".")
        assert found[h] == [".".join(labels[i:]) for i in range(len(labels))]
    assert df.select(F.explode("s").alias("x")).where("x is null").count() == 0
    assert "slice" not in df._jdf.queryExecution().optimizedPlan().toString()
