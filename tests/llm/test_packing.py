import itertools

import numpy as np
import pytest

from sightline.llm import packing


def padding(counts, ends):
    return sum(n * (next(e for e in ends if e >= length) - length) for length, n in enumerate(counts) if n)


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 6, 12) * (rng.random(12) < 0.7)
    lengths = np.flatnonzero(counts)
    for k in (1, 2, 3, 4):
        ends = packing.bucket_lengths(counts, k)
        if not len(lengths):
            assert ends == []
            continue
        best = min(
            padding(counts, sorted({*some, lengths[-1]}))
            for some in itertools.combinations(lengths.tolist(), min(k, len(lengths)) - 1)
        )
        assert len(ends) <= k and padding(counts, ends) == best


def test_every_token_is_packed_once_within_the_budget(spark, documents):
    lengths = packing.word_counts(documents)
    got = packing.pack(lengths, n_buckets=5, max_len=100, budget=400, block_rows=30).toPandas()
    want = {r["doc_id"]: r["n_tokens"] for r in lengths.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert (got.n_tokens <= got.bucket_len).all() and (got.padding == got.bucket_len - got.n_tokens).all()
    batches = got.groupby(["bucket_len", "batch"])
    assert ((batches.size() * got.bucket_len.groupby([got.bucket_len, got.batch]).first()) <= 400).all()
    assert not got.duplicated(["bucket_len", "batch", "slot"]).any()
    full = batches.size().groupby("bucket_len").apply(lambda s: (s.iloc[:-1] == 400 // s.name).all())
    assert full.all()


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, " ".join(["w"] * 5000))]
    got = packing.pack(packing.word_counts(docs_of(rows)), max_len=2048).toPandas()
    assert sorted(got.n_tokens) == [0, 0, 1, 2, 2, 904, 2048, 2048]
    assert packing.pack(packing.word_counts(docs_of([]))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packing.word_counts(docs_of(rows)), max_len=10, budget=5)
