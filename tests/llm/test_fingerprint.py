import hashlib

from pyspark.sql import functions as F

from sightline.llm import catalog, fingerprint


def prints(df):
    return {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}


def test_order_does_not_matter_and_content_does(spark, docs_of):
    got = prints(docs_of([(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b\nc d\ne\ne"), (4, "a b\nc d"), (5, None), (6, ""), (7, "a b\nc d\ne")]))
    assert got[1] == got[2] == got[7] and got[5] == got[6]
    assert len({got[1], got[3], got[4], got[5]}) == 4


def test_insertion_and_deletion(spark, docs_of):
    texts = {1: "one\ntwo\nthree", 2: "four\ntwo", 3: "one\ntwo\nthree\nfour\ntwo"}
    rows = docs_of(list(texts.items())).select("doc_id", F.explode(fingerprint.units(F.col("text"))).alias("unit"))
    v = {r["doc_id"]: r["vector"] for r in fingerprint.vectors(rows, ["doc_id"]).collect()}
    row = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>")
    got = row.select(
        (fingerprint.combine(F.col("a"), F.col("b")) == F.col("c")).alias("added"),
        (fingerprint.combine(F.col("c"), F.col("b"), -1) == F.col("a")).alias("taken"),
    ).first()
    assert got["added"] and got["taken"]


def test_likeness_follows_the_share_of_units(spark, docs_of):
    own = [f"unit {i} of the text" for i in range(400)]
    rows = [(0, "\n".join(own))] + [(k, "\n".join(own[: 400 - 40 * k] + [f"other {k} {i}" for i in range(40 * k)])) for k in range(1, 11)]
    exploded = docs_of(rows).select("doc_id", F.explode(fingerprint.units(F.col("text"))).alias("unit"))
    v = fingerprint.vectors(exploded, ["doc_id"])
    pairs = v.join(v.where("doc_id = 0").select(F.col("vector").alias("first")), how="cross")
    for r in pairs.select("doc_id", fingerprint.likeness(F.col("vector"), F.col("first")).alias("like")).collect():
        assert abs(r["like"] - (1 - r["doc_id"] / 10)) < 0.2
        assert r["doc_id"] or r["like"] == 1


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    want = []
    for k, (i, _) in enumerate(rows):
        half, after = len(texts[k]) // 2, texts[(k + 1) % len(texts)]
        edited = texts[k][: len(texts[k]) - half] + after[:half]
        want.append((str(i), len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), edited == texts[k]))
    facts = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"] == r["edited_fingerprint"]) for r in got]
    assert sorted(x[:3] for x in facts) == sorted(x[:3] for x in want)
    assert all(f for f, w in zip(sorted(x[3] for x in facts), sorted(x[3] for x in want)) if w)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_edited_texts_as_brute_force(spark, docs_of, documents):
    rows = [(5, "é𝄞abc"), (1, "x"), (1, "abcdef"), (9, None), (7, ""), (12, "last text\nof all"), (None, "no id"), (3, "long " * 9000)]
    check(rows, fingerprint.compare_edits(docs_of(rows)).collect())
    check([(1, "alone")], fingerprint.compare_edits(docs_of([(1, "alone")])).collect())
    assert fingerprint.compare_edits(docs_of([])).count() == 0
    small = fingerprint.with_next(documents, rows_per_block=3, n_ranges=7).orderBy("doc_id").collect()
    for a, b in zip(small, small[1:] + small[:1]):
        assert a["next_text"] == b["text"]


def test_query(spark, sf, text_of):
    got = catalog.QUERIES["op6_document_fingerprints"](spark, sf).collect()
    check(sorted(text_of.items()), got)
    by_text = {}
    for r in got:
        by_text.setdefault(text_of[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r["near_edited"] for r in got) > 3 * sum(r["near_next"] for r in got)


def test_native_plan(spark, sf):
    plan = catalog.QUERIES["op6_document_fingerprints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
