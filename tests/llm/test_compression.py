import hashlib
import math

import numpy as np
import pytest

from sightline.llm import catalog, compression


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) by plain loops over integers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(1024 * x) for x in v]))
    width = len(kept[0][2]) // 4 if kept else 0
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(4)]
    books = [[] for _ in range(4)]
    ids = sorted({i for i, *_ in kept if i is not None})[:entries]
    for i in ids:
        for book, part in zip(books, cut(min(v for j, _, v in kept if j == i))):
            book.append(part)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda book, part: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, _, v in kept:
                own.setdefault(nearest(book, cut(v)[p])[1], []).append(cut(v)[p])
            for k, parts in own.items():
                book[k] = [sum(x) // len(parts) for x in zip(*parts)]
    out = [(i, label, [nearest(b, part) for b, part in zip(books, cut(v))]) for i, label, v in kept]
    total = {}
    for _, label, found in out:
        total[label] = total.get(label, 0) + sum(f for f, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found), total[label], digest) for i, label, found in out]


def frame(spark, rows):
    extra = [(i, v, label, 1, "x") for i, v, label in rows]
    return spark.createDataFrame(extra, "vec_id long, embedding array<float>, label int, part int, v string")


def run(df, **settings):
    codes, books = compression.compress(df, **settings)
    return compression.with_label_errors(codes, books)


def check(df, rows, **settings):
    order = lambda r: tuple((x is None, x) for x in r)
    got = run(df, **settings).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    settings.pop("cell", None)
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows, **settings), key=order)


def vectors(n, dim, seed, copies=0):
    pick = np.random.default_rng(seed)
    centres = pick.normal(0, 0.3, (7, dim))
    found = (centres[pick.integers(0, 7, n)] + pick.normal(0, 0.05, (n, dim))).astype(np.float32)
    rows = [(int(i) * 3, v.tolist(), int(i) % 4 if i % 9 else None) for i, v in enumerate(found)]
    return rows + [(10_000 + i, rows[0][1], 1) for i in range(copies)]


@pytest.mark.parametrize("cell", [1, 16, 64, 100_000])
def test_any_cell_gives_the_same(spark, cell):
    rows = vectors(60, 8, 1, copies=30)
    check(frame(spark, rows).repartition(3), rows, entries=20, cell=cell)


def test_cases_as_brute_force(spark):
    good = vectors(20, 8, 2)
    odd = [
        (100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] * 8, 2), (104, [-float("inf")] * 8, 2),
        (0, good[5][1], 3), (None, good[6][1], 3), (None, good[7][1], None), (-5, good[0][1], 1), (-5, good[1][1], 1), (200, [0.0] * 8, 7), (201, [-0.0] * 8, 7),
    ]
    check(frame(spark, good + odd), good + odd, entries=12)
    short = [(300, [1.0] * 4, 1), (301, [1.0] * 7, 1), (302, [], 1)]  # of another length than most
    check(frame(spark, good + short), good, entries=12)
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, odd[:5])).count() == 0
    assert run(frame(spark, [(None, [1.0] * 4, 1)])).count() == 0
    large = [(1, [1e30, -1e30, 0.0, 0.0], 1), (2, [0.0] * 4, 1)]
    assert [r["code"] for r in run(frame(spark, large)).orderBy("vec_id").collect()] == ["00000000", "01010000"]


def test_sparse_ids(spark):
    rows = [(i**7 - 50, v, label) for (i, v, label) in vectors(50, 4, 3)]
    check(frame(spark, rows), rows, entries=9)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(compression, "MEMO", 40)
    pick = np.random.default_rng(0)
    book, points = pick.integers(-300, 300, (50, 6)), pick.integers(-300, 300, (3000, 6))
    cells = compression.Cells(book, 64)
    monkeypatch.setattr(compression, "CHUNK", 30)
    entry, far = cells.nearest(points)
    every = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert len(cells.memo) <= 40


def test_dominated_entries_are_not_evaluated():
    pick = np.random.default_rng(0)
    book = pick.integers(-3000, 3000, (256, 4))
    cells = pick.integers(-40, 40, (100, 4))
    left = compression.Cells(book, 64).candidates(cells)
    assert left.any(axis=1).all() and left.mean() < 0.1


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = catalog.QUERIES["op13_vector_compression"](spark, sf)
    # Brute force by numpy: the same integers.
    ints = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in rows], dtype=np.int64)
    order = np.argsort([i for i, *_ in rows])[:256]
    width = ints.shape[1] // 4
    books = [ints[order, p * width : (p + 1) * width] for p in range(4)]
    for step in range(5):
        far = [((ints[:, p * width : (p + 1) * width][:, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        if step < 4:
            for p in range(4):
                own = far[p].argmin(axis=1)
                for k in set(own.tolist()):
                    part = ints[own == k, p * width : (p + 1) * width]
                    books[p][k] = part.sum(axis=0) // len(part)
    codes = np.stack([f.argmin(axis=1) for f in far], axis=1).astype(np.uint8)
    want = {i: (bytes(c).hex(), int(e)) for (i, *_), c, e in zip(rows, codes, sum(f.min(axis=1) for f in far))}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == want
