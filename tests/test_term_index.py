import random
import re

from pyspark.sql import functions as F

from sightline.functions.text import normalize_text, term_pattern
from sightline.operators import term_index as T

NEEDLES = [
    ("P", "Nimbo", True), ("P", "Nimbo City", True), ("P", "the city", True), ("P", "A.B", True), ("P", "!!!", True), ("P", "l'été", True), ("P", "C++", True),
    ("P", "x.io", False), ("P", "nimbo.city", False), ("P", "localhost", False), ("P", "a.b", False), ("P", "sub.nimbo.city", False), ("Q", "Nimbo", True), ("Q", ".com", False),
]
TEXTS = [
    (1, "P", "Nimbo, the City of NIMBO CITY"), (2, "P", "at ax.ios and L'Ete!!!"), (3, "Q", "nimbo at shop.com"), (4, "P", "a.b and localhosts c++"),
    (5, "P", "http://sub.nimbo.city/x."), (6, "P", ""), (7, "P", None), (8, "R", "Nimbo"), (9, "P", "nimbos"), (10, "P", "...x.io... a..b"),
]


def frames(spark, texts, needles):
    t = spark.createDataFrame(texts, "id int, project_id string, body string").withColumn("body", normalize_text(F.col("body")))
    n = spark.createDataFrame(needles, "project_id string, needle string, is_term boolean")
    bare = F.trim(normalize_text(F.col("needle")))
    return t, n.withColumns({"bare": bare, "pattern": term_pattern(F.col("needle"))})


def matches(found):
    hit = F.when(F.col("is_term"), F.regexp_instr("body", F.col("pattern")) > 0).otherwise(F.lit(True))
    return sorted((r.id, r.needle) for r in found.where(hit).select("id", "needle").collect())


def test_same_as_every_text_with_every_term(spark):
    t, n = frames(spark, TEXTS, NEEDLES)
    every = t.join(n, (t.project_id == n.project_id) & F.contains(t.body, n.bare)).drop(n.project_id)
    want = matches(every)
    assert matches(T.holding(t, n, "id")) == want and len(want) > 14


def test_random_texts_and_terms(spark):
    pick = random.Random(7)
    word = lambda: "".join(pick.choice("ab.é' ") for _ in range(pick.randint(1, 5)))
    needles = [("P", w.strip() or "a", k % 3 > 0) for k, w in enumerate(word() for _ in range(150))]
    needles = sorted(set(n for n in needles if n[2] or " " not in n[1]))
    texts = [(i, "P", "".join(word() for _ in range(6))) for i in range(120)]
    t, n = frames(spark, texts, needles)
    every = t.join(n, (t.project_id == n.project_id) & F.contains(t.body, n.bare)).drop(n.project_id)
    assert matches(T.holding(t, n, "id")) == matches(every)


def test_many_terms_in_one_project(spark):
    """100,000 terms: the join's rows follow the texts, not texts times terms."""
    n = spark.range(100_000).select(F.lit("P").alias("project_id"), F.concat(F.lit("Brand "), F.col("id").cast("string")).alias("needle"), F.lit(True).alias("is_term"))
    n = n.withColumns({"bare": F.trim(normalize_text(F.col("needle"))), "pattern": term_pattern(F.col("needle"))})
    texts = [(i, "P", f"we like brand {i} and Brand {i * 300}, not brandy 5") for i in range(300)]
    t = spark.createDataFrame(texts, "id int, project_id string, body string").withColumn("body", normalize_text(F.col("body")))
    found = T.holding(t, n, "id")
    want = sorted({(i, f"Brand {k}") for i in range(300) for k in (i, i * 300)})
    assert matches(found) == want
    met = T.asked(t, "id").join(T.posted(n), ["project_id", "key"]).count()
    assert met < 20 * len(texts)
    plan = T.holding(t, n, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(project_id#\d+ = project_id#\d+\)", plan)


def test_a_small_index_meets_the_texts_in_one_pass(spark):
    t, n = frames(spark, TEXTS, NEEDLES)
    at_once, by_keys = T.holding(t, n, "id", small=True), T.holding(t, n, "id")
    assert T.few(n) and matches(at_once) == matches(by_keys)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(at_once) and plan(at_once).count("Join Inner") == plan(by_keys).count("Join Inner") - 1


def test_repeated_ids_in_one_pass(spark):
    """Every text of an id with the needles that any text of the id asks for, row by row; a null id has none."""
    again = [(1, "P", "nimbo at a.b"), (1, "Q", "nimbo shop.com"), (2, "P", "at ax.ios and L'Ete!!!"), (2, "P", None), (None, "P", "nimbo"), (None, "P", "nimbo")]
    t, n = frames(spark, TEXTS + again, NEEDLES)
    rows = lambda df: sorted((r.id, r.body, r.project, r.needle) for r in df.collect())
    n = n.withColumn("project", F.col("project_id"))
    want = rows(T.holding(t, n, "id"))
    assert rows(T.holding(t, n, "id", small=True)) == want and len(want) > len(set(want))


def test_many_needles_are_not_few(spark):
    assert T.few(spark.range(T.SMALL)) and not T.few(spark.range(T.SMALL + 1))
