import re
from collections import Counter

import pyarrow as pa
import pytest

from sightline.llm import catalog, exchange, setjoin, words
from sightline.llm.links import components


def brute(rows, shingle=3, percent=90):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, set(zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def tuples(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def near_copies(n, words=60, step=1):
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        text[(k * step) % words] = f"edit{k}"
        if k % 3 == 0:
            text[(k * 7 + 11) % words] = f"more{k}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("percent", [90, 80, 95])
def test_groups_near_the_bound(spark, docs_of, percent):
    rows = near_copies(40) + [(100 + i, t) for i, t in near_copies(30, words=45, step=3)]
    rows += [(200 + k, " ".join(f"c{i}" for i in range(k, k + 62))) for k in range(0, 40, 2)]  # a chain
    got = setjoin.similar_components(docs_of(rows), percent=percent)
    assert tuples(got) == brute(rows, percent=percent)


def test_edge_cases(spark, docs_of):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long), (8, long + " x"), (9, "a b c"), (10, "A\tb\nC"), (11, "É b c"), (12, "é b c")]
    assert tuples(setjoin.similar_components(docs_of(rows))) == brute(rows)
    assert setjoin.similar_components(docs_of([])).count() == 0
    twice = setjoin.similar_components(docs_of([(5, "a b c d"), (5, "a b c d"), (6, "a b c d")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(5, 5), (5, 5), (6, 5)]


def test_query(spark, sf, text_of):
    got = catalog.QUERIES["op4_ngram_jaccard_join"](spark, sf)
    assert tuples(got) == brute(sorted(text_of.items()))


def test_a_shingle_of_all_texts_is_one_entry_per_block(spark, docs_of):
    """Counts of shared hashes equal brute force, with common shingles and several blocks."""
    common = " ".join(f"head{i}" for i in range(40))
    rows = [(i, f"{common} " + " ".join(f"own{i}x{j % (3 + i % 5)}y{j}" for j in range(30))) for i in range(200)]
    rows += [(7, "another text of a known id"), (None, common), (300, None), (301, "")]
    read = docs_of(rows).selectExpr("doc_id", "coalesce(text, '') AS text", "pmod(xxhash64(doc_id), 6) AS block")
    got = {r["doc_id"]: r["shared"] for r in setjoin.shared_low(read, 3, 3).collect()}

    lows = [(i, s[s < setjoin.LOW]) for i, s in zip([i for i, _ in rows], setjoin.shingle_sets(words.of_texts(pa.array([t or "" for _, t in rows]), lower=True), 3))]
    seen = Counter(k for _, low in lows for k in low.tolist())
    want = Counter()
    for i, low in lows:
        want[exchange.NO_ID if i is None else i] += sum(seen[k] > 1 for k in low.tolist())
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 70), (70, 90), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 61)} | {100: 70, 70: 70, 90: 70}
    assert {r["node"]: r["component"] for r in got} == want
