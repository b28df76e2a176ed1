import hashlib
import re

import numpy as np
import pytest

from sightline.llm import catalog, exchange, substrings


def brute(rows, size=13):
    far = exchange.NO_ID
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            low[key] = min(low.get(key, far), far if i is None else i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < (far if i is None else i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def tuples(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def texts(n, seed, vocabulary=30):
    """Texts with many common stretches: pieces of a few long sequences, some words changed."""
    rng = np.random.default_rng(seed)
    sources = [[f"w{x}" for x in rng.integers(0, vocabulary, 200)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            s = sources[int(rng.integers(4))]
            a = int(rng.integers(0, 180))
            w += s[a : a + int(rng.integers(1, 60))]
        for k in rng.integers(0, max(len(w), 1), 2):
            if w and rng.random() < 0.5:
                w[k] = "x"
        rows.append((int(rng.integers(0, n)) if rng.random() < 0.1 else i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, docs_of, seed, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(exchange, "SHARD_BYTES", 9000)
    rows = texts(150, seed)
    assert tuples(substrings.removed_words(docs_of(rows))) == brute(rows)


def test_few_words(spark, docs_of):
    rows = texts(60, 9, vocabulary=2)
    assert tuples(substrings.removed_words(docs_of(rows), size=5, gram=2)) == brute(rows, 5)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_give_the_same(spark, docs_of, hot, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(exchange, "SHARD_BYTES", 9000)
    rows = texts(150, 4)
    assert tuples(substrings.removed_words(docs_of(rows), hot_passages=hot)) == brute(rows)


def test_a_shared_header_needs_no_automaton_of_all_documents(spark, docs_of, monkeypatch):
    plain = substrings._window_lows

    def bounded(passages, *others):
        _, counts = np.unique(passages.column("key").to_numpy(), return_counts=True)
        assert counts.max(initial=0) <= 64
        return plain(passages, *others)

    monkeypatch.setattr(substrings, "_window_lows", bounded)
    header = " ".join(f"head{i}" for i in range(20))
    rows = [(i, f"{header} " + " ".join(f"own{i}x{k}" for k in range(10))) for i in range(300)]
    rows += [(300 + i, " ".join(f"own{i}x{k}" for k in range(4)) + f" {header} own{i % 7}x0 own{i % 7}x1") for i in range(100)]
    assert tuples(substrings.removed_words(docs_of(rows))) == brute(rows)


def test_edge_cases(spark, docs_of):
    run = " ".join(f"w{i}" for i in range(13))
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, run), (4, run), (5, "a b " + run.replace(" ", "\n ")), (None, run), (6, run[:-3]), (7, long), (8, long + " end"), (0, "é" * 50)]
    assert tuples(substrings.removed_words(docs_of(rows))) == brute(rows)
    assert substrings.removed_words(docs_of([])).count() == 0


def test_automaton_statistics():
    a = substrings.Automaton()
    for doc, text in ((5, "a b c d e"), (3, "x b c d"), (9, "b c d e f")):
        a.add(text.split(), doc)
    a.finish()
    assert a.statistics("a b c d e f".split(), 3) == [5, 3, 5, 9]
    assert a.statistics("x b c q".split(), 3) == [3, exchange.NO_ID]


def test_query(spark, sf, text_of):
    assert tuples(catalog.QUERIES["op9_substring_dedup"](spark, sf)) == brute(sorted(text_of.items()))
