import pytest
from pyspark.sql import functions as F

from sightline.operators import compare as C
from sightline.operators import robots as B
from sightline.operators import scoring as S
from sightline.operators.page_type import with_page_type
from sightline.operators.signals import extract_signals

NOW = F.lit("2026-09-08 12:00:00").cast("timestamp_ntz")

LISTICLE = """<!doctype html><html lang="fr"><head><title>Top 7 des meilleures agences web à Laval en 2026 | Guidio</title>
<meta name="description" content="Sept agences comparées"><link rel="canonical" href="https://guidio.ca/top-agences/">
<meta property="article:modified_time" content="2026-08-01T09:00:00Z">
<script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Article","datePublished":"2026-02-03","author":{"@type":"Person","name":"Lise Roy","jobTitle":"rédactrice"}},
{"@type":"Organization","name":"Guidio","sameAs":["https://linkedin.com/company/guidio"]},{"@type":"ItemList"}]}</script></head>
<body><header><span>Guidio</span><nav><a href="/contact">Contact</a></nav></header>
<main><h1>Top 7 des agences</h1><p>Une agence web à Laval coûte de 2 000 $ à 9 000 $. Les délais vont de 3 semaines à 6 mois. La meilleure agence dépend du projet.</p>
<h2>En bref</h2><p>Trois noms ressortent.</p>
<h2>1. Alphatek</h2><p>Note de 4,8 selon <a href="https://www.clutch.co/x#y">Clutch</a> et 95 % de clients ravis.</p>
<h2>2. Bétaweb</h2><p>Voir <a href="https://www.w3.org/">W3C</a> et <a href="https://facebook.com/b">Facebook</a>.</p>
<h2>3. Gamma Studio</h2><ul><li>Rapide</li><li>Local</li></ul>
<h3>4. Deltacom</h3><table><tr><td>x</td></tr></table><h3>5. Epsilon</h3><blockquote>Un excellent travail.</blockquote></main>
<footer>© Guidio</footer></body></html>"""

SERVICE = """<html><head><title>Agence de marketing - Nordik</title></head><body><h1>Agence de marketing</h1>
<p>Nos services commencent à partir de 500 $ par mois. Demandez une soumission.</p>
<form action="/contact"><input type="email"></form></body></html>"""

EMPTY = '<html><head><title>App</title></head><body><div id="root"></div><script>boot()</script></body></html>'

NEWS = """<html lang="en"><head><title>City approves plan</title><meta name="robots" content="noindex, max-snippet:0">
<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2024-01-05","author":"Ann Poe"}</script>
<script type="application/ld+json">{bad json</script></head><body><article><h1>City approves plan</h1>
<p>By Ann Poe, reporter. Updated on March 12, 2024. The council voted 7 days ago on the plan for the city and the region.</p></article></body></html>"""

GUIDE = """<html lang="fr"><head><title>Comment choisir : guide en 3 étapes</title></head><body><main><h1>Comment choisir</h1>
<h2>Étape 1 : définir</h2><p>a</p><h2>Étape 2 : comparer</h2><p>b</p><h2>Pourquoi ?</h2><p>c</p><h2>Combien ?</h2><h2>Quand ?</h2></main></body></html>"""

DOCS = '<html><head><title>API</title></head><body><h1>API</h1><p>x</p></body></html>'
GOV = '<html><head><title>Ministère des travaux</title></head><body><h1>Loi</h1></body></html>'

PAGES = [
    (1, "https://www.guidio.ca/top-agences", LISTICLE, "fr", "Laval"),
    (2, "https://nordik.ca/services/", SERVICE, "en", "Montréal"),
    (3, "https://app.io/", EMPTY, None, None),
    (4, "https://journal.com/a", NEWS, "fr", None),
    (5, "https://x.ca/guide", GUIDE, None, None),
    (6, "https://developers.google.com/search", DOCS, None, None),
    (7, "https://www.quebec.ca/loi", GOV, None, None),
    (8, "https://clutch.co/agencies", DOCS, None, None),
]


@pytest.fixture(scope="module")
def signals(spark):
    df = spark.createDataFrame(PAGES, "page_id int, url string, html string, question_lang string, place string")
    return with_page_type(extract_signals(df)).cache()


@pytest.fixture(scope="module")
def page(signals):
    return {r.page_id: r for r in signals.collect()}


def test_page_types(page):
    kinds = {i: p.page_type for i, p in page.items()}
    assert kinds == {1: "listicle", 2: "service", 3: "other", 4: "news", 5: "guide", 6: "documentation", 7: "institutional", 8: "directory"}
    assert page[3].type_confidence == 0.3 and page[1].type_confidence == 0.95


def test_listicle_signals(page):
    p = page[1]
    assert (p.lang, p.author, p.author_role, p.person_schema, p.organization_schema) == ("fr", "Lise Roy", "rédactrice", True, True)
    assert (p.date_modified, p.date_published, p.title_year) == ("2026-08-01T09:00:00Z", "2026-02-03", 2026)
    assert p.outbound_domains == ["clutch.co", "w3.org"] and p.outbound_links == 2
    assert (p.lists_count, p.tables_count, p.quote_count, p.h2_entities) == (1, 1, 1, 5)
    assert p.has_summary_block and not p.has_faq and p.about_contact_links and p.canonical_self
    assert (p.brand_name, p.brand_consistent) == ("Guidio", True)
    assert p.place_mentioned is True
    assert p.lang_matches is True and p.json_ld_types == ["Article", "Organization", "ItemList"]
    assert [s.heading for s in p.sections][:2] == ["En bref", "1. Alphatek"]


def test_other_signals(page):
    assert (page[2].price_from, page[2].quote_cta, page[2].our_services, page[2].contact_form) == (True, True, True, True)
    assert page[2].place_mentioned is False and page[2].brand_name == "Nordik"
    assert (page[3].js_suspect, page[3].word_count) == (True, 0)
    assert (page[4].author, page[4].date_modified, page[4].snippet_directives) == ("Ann Poe", "2024-03-12", ["max-snippet:0", "noindex"])
    assert page[4].author_role == "reporter" and page[4].lang_matches is False
    assert page[5].has_faq and page[5].h2_questions == 3


def fetched(signals):
    return signals.withColumns(
        {
            "all_allowed": F.lit(True), "blocked_agents": F.array().cast("array<string>"), "http_status": F.lit(200),
            "response_ms": F.when(F.col("page_id") == 2, 2000).otherwise(800), "redirects": F.when(F.col("page_id") == 4, 1).otherwise(0),
            "llms_txt": F.lit(None).cast("boolean"),
        }
    )


def test_access_scores(signals):
    a = {r.page_id: r for r in S.score_access(fetched(signals)).select("page_id", "access").collect()}
    points = {i: {x.key: x.points for x in r.access.rows} for i, r in a.items()}
    assert a[1].access.total == 6 + 4 + 3 + 0 + 3 and sum(x.max for x in a[1].access.rows) == 20
    assert points[2]["responseTime"] == 2 and points[4]["http"] == 2 and points[4]["snippets"] == 0
    assert S.UNREADABLE in a[3].access.caps


def test_content_scores(signals):
    asked = signals.filter("page_id in (1, 2)").withColumns(
        {"question": F.lit("Quelle est la meilleure agence web à Laval ?"), "intent": F.lit("comparative")}
    )
    c = {r.page_id: r.content for r in S.score_content(asked, NOW).select("page_id", "content").collect()}
    one = {x.key: x.points for x in c[1].rows}
    assert sum(x.max for x in c[1].rows) == 40
    assert one == {
        "fit": 7, "directAnswer": 6, "headings": 2, "listsTables": 2, "faqSummary": 2, "numbers": 3, "sources": 2, "quotes": 1,
        "specificity": 0, "freshness": 4, "author": 2, "profiles": 1, "brand": 1,
    }
    two = {x.key: x for x in c[2].rows}
    assert two["fit"].points == 4 and two["brand"].points == 0
    judged = asked.withColumns({"judge_fit": F.lit(3), "judge_direct_answer": F.lit(3), "judge_specificity": F.lit(2)})
    j = {r.page_id: {x.key: x.points for x in r.content.rows} for r in S.score_content(judged, NOW).select("page_id", "content").collect()}
    assert (j[1]["fit"], j[1]["directAnswer"], j[1]["specificity"]) == (10, 8, 2)
    assert j[2]["fit"] == 4


def brute_direct(first_quarter, sections, terms):
    """The plain double loop over all runs of sentences."""
    import re

    def count(t):
        return sum(1 for w in terms if re.search(rf"(?<!\w){re.escape(w)}(?:s|x|es)?(?!\w)", t.lower()))

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", first_quarter) if s]
    best, passage = 0, None
    for i in range(len(sentences)):
        for j in range(i, len(sentences)):
            run = " ".join(sentences[i : j + 1])
            if len(run.split()) > 80:
                break
            if count(run) > best:
                best, passage = count(run), run
    if best >= 2:
        return 6, passage
    for heading, lead in sections:
        if count(heading) >= 2 and len(lead.split()) >= 20:
            return 6, lead
    return (3, passage) if best == 1 else (0, None)


def test_direct_answer_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for n in range(60):
        words = [rng.choice(["red", "green", "blue", "agence", "agences", "web", "x", "y", "z", "prix"]) for _ in range(rng.randint(0, 300))]
        body = " ".join(w + rng.choice(["", "", "", ".", "?"]) for w in words)
        terms = rng.sample(["agence", "web", "prix", "nope", "zut"], rng.randint(0, 4))
        rows.append((n, body, [("agence web", " ".join(["w"] * rng.choice([5, 25])))], terms))
    df = spark.createDataFrame(rows, "n int, text_in_first_quarter string, sections array<struct<heading:string,lead:string>>, terms array<string>")
    got = {r.n: (r.direct_points, r.direct_passage) for r in S.score_direct_answer(df).collect()}
    for n, body, sections, terms in rows:
        assert got[n] == (brute_direct(body, sections, terms) if terms else (0, None)), n


def test_upper_median_and_readings(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 30), (1, 2, 20), (1, 3, 5), (2, 0, 7)], "page_id int, q int, t int")
    got = {r.page_id: (r.questions, r.median_total) for r in S.upper_median(df, ["page_id"], F.col("t"), "q").collect()}
    assert got == {1: (4, 20), 2: (1, 7)}
    r = spark.createDataFrame([(7, 40, 40), (20, 30, 10), (20, 20, 10), (20, 10, 30), (20, 30, 20)], "a int, c int, r int")
    assert [x[0] for x in r.select(S.recommended_reading(F.col("a"), F.col("c"), F.col("r"))).collect()] == ["access-low", "search", "content", "brand", "neutral"]


def test_compare_and_typology(signals, spark):
    pairs = spark.createDataFrame([(1, 2), (1, 5), (5, 1)], "target_id int, page_id int")
    rows = {(r.target_id, r.key): r for r in C.compare_signals(signals, pairs, NOW).collect()}
    w = rows[(5, "tablesCount")]
    assert (w.target, w.median, w.gap, w.same_type_only, w["sample"]) == (0.0, 1.0, 1.0, False, 1)
    assert rows[(1, "tablesCount")].gap == -1.0 and rows[(1, "tablesCount")]["sample"] == 2
    top = C.top_gaps(C.compare_signals(signals, pairs, NOW)).filter("target_id = 5").collect()
    assert len(top) == 3 and all(t.gap > 0 for t in top)
    t = C.page_typology(signals, pairs).filter("target_id = 1").collect()
    assert {(x.page_type, x["count"], x.examples) for x in t} == {("service", 1, "nordik.ca"), ("guide", 1, "x.ca")}


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: GPTBot\nDisallow: /\n"
    files = spark.createDataFrame([("https://a.ca", body), ("https://b.ca", None)], "origin string, body string")
    p = spark.createDataFrame(
        [(1, "https://a.ca", "/private/x"), (2, "https://a.ca", "/private/ok"), (3, "https://b.ca", "/"), (4, "https://c.ca", "/")],
        "page_id int, origin string, page_path string",
    )
    a = B.robots_access(p, files).cache()
    got = {(r.page_id, r.agent): (r.allowed, r.explicit) for r in a.collect()}
    assert got[(1, "GPTBot")] == (False, True) and got[(1, "ClaudeBot")] == (False, False)
    assert got[(2, "GPTBot")] == (False, True) and got[(2, "ClaudeBot")] == (True, False)
    assert all(got[(i, "GPTBot")] == (True, False) for i in (3, 4))
    r = {x.page_id: x for x in B.access_report(a).collect()}
    assert r[2].blocked_agents == ["GPTBot"] and r[3].all_allowed and len(r[1].blocked_agents) == 9


def test_nothing_is_cut(spark):
    """Texts that differ late have different hashes; sections after the 40th and headings after the 12th count."""
    from sightline.operators.signals import content_hash, page_info

    filler = "".join(f"<p>Paragraph {i} says what it says at some length, as paragraphs do.</p>" for i in range(60))
    sections = "".join(f"<h2>Part {i}?</h2><p>Text of the part.</p>" for i in range(60))
    rows = [(n, f"https://x.ca/{n}", f"<html><body><main><h1>T</h1>{filler}<p>The end is {n}.</p>{sections}</main></body></html>") for n in (1, 2)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    info = page_info(pages).select("page_id", content_hash(F.col("title")).alias("hash"), F.size("h2").alias("n")).collect()
    assert len({r.hash for r in info}) == 2 and {r.n for r in info} == {60}
    s = extract_signals(pages).select(F.size("sections").alias("n"), F.element_at("sections", 60).alias("last"), F.size("h3").alias("h3")).first()
    assert (s.n, s.last.heading, s.last.lead) == (60, "Part 59?", "Text of the part.")


def test_many_headings_take_seconds(spark):
    import time

    from sightline.operators.html import flatten

    page = "<html><body><main>" + "".join(f"<h2>Heading {i}</h2><p>Its text {i}.</p>" for i in range(5000)) + "</main></body></html>"
    start = time.perf_counter()
    found = [e for e in flatten(page)["elements"] if e["tag"] == "h2"]
    assert time.perf_counter() - start < 5
    assert len(found) == 5000 and found[4321]["lead"] == "Its text 4321." and found[7]["text"] == "Heading 7"


def test_running_sums_of_long_lists(spark):
    lists = [[], [3], list(range(64)), list(range(65)), [i * 7 % 13 for i in range(1000)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {r.i: r.s for r in df.select("i", S.running_sums(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == [sum(x[:k]) for k in range(len(x) + 1)]


def test_middle_question_is_picked(spark):
    rows = [(1, q, t) for q, t in enumerate([10, 30, 20, 20, 5])] + [(2, 4, 9), (2, 2, 9), (2, 3, 9), (2, 1, 9)]
    df = spark.createDataFrame(rows, "page_id int, q int, t int")
    got = {r.page_id: (r.questions, r.median_total, r.q) for r in S.upper_median(df, ["page_id"], F.col("t"), "q").collect()}
    assert got == {1: (5, 20, 2), 2: (4, 9, 3)}


def test_robots_groups_and_patterns(spark):
    body = "# c\r\nUser-agent: ClaudeBot\nUser-agent: PerplexityBot\nDisallow: /*?page=\nAllow: /x$\nDisallow: /x\n\nUser-agent: ClaudeBot\nDisallow: /late"
    files = spark.createDataFrame([("o", body)], "origin string, body string")
    p = spark.createDataFrame([(1, "o", "/a?page=2"), (2, "o", "/x"), (3, "o", "/xy"), (4, "o", "/late"), (5, "o", "/")], "page_id int, origin string, page_path string")
    got = {(r.page_id, r.agent): r.allowed for r in B.robots_access(p, files).collect()}
    assert [got[(i, "ClaudeBot")] for i in range(1, 6)] == [False, True, False, False, True]
    assert [got[(i, "PerplexityBot")] for i in range(1, 6)] == [False, True, False, True, True]
    assert all(got[(i, "GPTBot")] for i in range(1, 6))


def test_robots_as_brute_force(spark):
    """Random files and paths, one origin with most of them, against one rule after the other."""
    import random
    import re

    rng = random.Random(11)
    agents = ["GPTBot", "ClaudeBot", "PerplexityBot", "*", "OtherBot"]
    piece = lambda: rng.choice(["/a", "/b", "/ab", "/a.b", "/?q=", "/c+"])
    path = lambda: "".join(piece() for _ in range(rng.randint(1, 4)))
    sites, lines = {}, {}
    for o in ("hot", "o1", "o2", "o3"):
        sites[o], lines[o] = {}, []
        for agent in rng.sample(agents, 3):
            rules = []
            lines[o].append(f"User-agent: {agent}")
            for _ in range(rng.randint(0, 40 if o == "hot" else 6)):
                p = rng.choice(["", "", "*", "/*"]) + path() + rng.choice(["", "", "", "$", "*", "*b", "$x"])
                allow = rng.random() < 0.4
                rules.append((p, allow))
                lines[o].append(f"{'Allow' if allow else 'Disallow'}: {p}")
            sites[o][agent.lower()] = rules
    files = spark.createDataFrame([(o, "\n".join(x)) for o, x in lines.items()] + [("none", None)], "origin string, body string")
    rows = [(i, rng.choice(["hot"] * 5 + ["o1", "o2", "o3", "none", None]), rng.choice([path(), path(), path(), "", None])) for i in range(600)]

    def allowed(origin, page, agent):
        groups = sites.get(origin, {})
        rules = groups.get(agent.lower(), groups.get("*", []))
        hits = []
        for p, allow in rules:
            end = p.endswith("$")
            pattern = ".*".join(re.escape(x) for x in (p[:-1] if end else p).split("*")) + ("$" if end else "")
            if page is not None and re.match(pattern, page):
                hits.append((len(p), allow))
        return max(hits)[1] if hits else True

    got = B.robots_access(spark.createDataFrame(rows, "page_id int, origin string, page_path string"), files).collect()
    asked = {i: (o, p) for i, o, p in rows}
    assert len(got) == 600 * 9
    for r in got:
        o, p = asked[r.page_id]
        assert r.allowed == allowed(o, p, r.agent), (o, p, r.agent)
        assert r.explicit == (r.agent.lower() in sites.get(o, {}))
    assert any(not r.allowed for r in got)


def test_figures_of_each_kind(spark):
    from sightline.functions.text import count_numbers

    cases = {
        "$ 12 and 1 200,50 euros": 2, "50 % or 3 pour cent": 2, "on 2024-05-06, 3 mars 2021 or May 4, 2020 or 1/2/1999": 4,
        "in 1998 but not 20245 nor 3-1998": 1, "3 semaines, 12 kg, 5 pages": 3, "version 3 of item 12": 0,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.n for r in df.select("t", count_numbers(F.col("t")).alias("n")).collect()} == cases
