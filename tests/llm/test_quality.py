import numpy as np
import pytest

from sightline.llm import catalog, quality

LABELS = "doc_id long, quality int, toxic int, text string"


def test_em_finds_accurate_and_careless_labellers():
    rng = np.random.default_rng(0)
    n = 8000
    kind = rng.choice(3, n, p=[0.8, 0.15, 0.05])  # clean, and two kinds of bad texts
    finds = lambda hit, wrong: np.where(rng.random(n) < np.where(hit, 0.9, wrong), -1, 1)
    votes = [finds(kind == 1, 0.01), finds(kind == 2, 0.01), finds(np.zeros(n, bool), 0.2)]
    votes.append(np.where(rng.random(n) < 0.1, np.where(kind > 0, -1, 1), 0))
    votes = [np.where(rng.random(n) < 0.1, 0, v) for v in votes]
    patterns, at, counts = np.unique(np.stack(votes, axis=1), axis=0, return_inverse=True, return_counts=True)
    bad, given, badness = quality.estimate(patterns, counts.astype(float))
    assert given[1, 0, 0] > 0.7 > 0.05 > given[0, 0, 0] and given[2, 1, 0] > 0.7
    assert badness[1] > 0.8 and badness[2] > 0.7 and badness[3] < 0.3
    assert ((bad[at] > 0.5) == (kind > 0)).mean() > 0.95


def test_held_out_accuracy(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    junk = got[got.quality == 0]
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert (~junk.keep).mean() > 0.95
    assert clean.keep.mean() > 0.98
    assert got[(got.toxic == 1) & (got.quality == 1)].keep.mean() < 0.6


def test_learned_words_and_their_absence(spark, docs_of):
    rows = [(i, f"plain words n{i} {'vexor' if i % 3 == 0 else 'calm'} text{i}") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "clash") for i in range(90)] + [(None, None, None, None)], LABELS)
    assert quality.learn_abuse(docs_of(rows), labels, 100).tolist() == quality.word_hashes(["vexor"]).tolist()
    assert len(quality.learn_abuse(docs_of(rows), labels.limit(0), 100)) == 0


def test_nulls_empty_and_repeated_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "A plain sentence about nothing in particular, for once."), (3, "A plain sentence about nothing in particular, for once."), (4, "| ".join(["junk"] * 2000)), (None, "Another plain sentence, with no id at all.")]
    labels = spark.createDataFrame([], LABELS)
    got = quality.classify(docs_of(rows), labels).collect()
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert len(got) == 6 and keep[1] and keep[2] and keep[3] and not keep[4]
    kept = quality.keep_good(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.count() == 5
    assert quality.classify(docs_of([]), labels).count() == 0


def test_a_repeated_id_is_one_row_of_the_sample(spark, docs_of):
    """The bounded sample is the same whatever the number of copies of a row, and texts of an id count once."""
    kinds = lambda i: "calm words and so on, told at some length here." if i % 4 else "| ".join(["junk"] * 60)
    rows = [(i, f"{kinds(i)} n{i}") for i in range(300)]
    hot = rows + [(5, f"{kinds(5)} n5")] * 400
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, "clash") for i in range(0, 300, 2)], LABELS)
    seen = []

    def keep_rows(row, slot, value, target):
        seen.append(target)
        return np.zeros(quality.N_WEIGHTS), 0.0

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train_scorer", keep_rows)
        for given in (rows, hot, rows + [(5, f"other {k}") for k in range(400)]):
            quality.fit(docs_of(given), labels, train_rows=40)
    assert [len(t) for t in seen] == [40, 40, 40]


def test_votes_abstain_where_texts_are_short():
    import pyarrow as pa

    from sightline.llm import words

    w = words.stripped(words.of_texts(pa.array(["HELP ME NOW", "", None, "go go go go go go go go go"])))
    votes = quality.labeller_votes(w, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert votes["capitals"].tolist()[:3] == [0, 0, 0]
    assert votes["repetition"].tolist() == [0, 0, 0, -1]


def test_query_returns_kept_documents(spark, sf):
    got = catalog.QUERIES["op2_quality_classifier"](spark, sf)
    assert got.columns == ["doc_id", "p_bad"]
    assert got.where("p_bad >= 0.5").count() == 0
    assert pytest.approx(got.count(), abs=60) == 160
