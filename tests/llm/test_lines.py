import hashlib
import re

import pytest

from sightline.llm import catalog, lines


def brute(rows, size, least=50):
    """Lines that stay per row, by looking at every window of lines."""
    seen, out = set(), []
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        split = (text or "").split("\n")
        gone = set()
        for length in range(1, size + 1):
            for a in range(len(split) - length + 1):
                window = tuple(split[a : a + length])
                long = length == size or sum(len(re.findall(r"[^\x20\x09-\x0D]+", w)) for w in window) >= least
                if long and any(w.strip(" ") for w in window):
                    if window in seen:
                        gone.update(range(a, a + length))
                    seen.add(window)
        out.append((i, "\n".join(w for k, w in enumerate(split) if k not in gone)))
    return out


CASES = [
    (1, "a\nb\nc\nd\ne"),
    (2, "x\nb\nc\nd\ny"),
    (3, "a\nb\nc\nd\ne"),
    (4, "q\nq\nq\nq\nq\nq"),
    (5, "\n\n\n\n\n"),
    (6, "\n\n\n\n\n"),
    (7, None),
    (8, ""),
    (9, "c\nd\nz\nc\nd\nz\nc"),
    (10, "\n".join(f"line {i % 7}" for i in range(3000))),
    (11, "b\nc"),
    (12, "one two three four five"),
    (13, "x\none two three four five\ny"),
    (14, "six  seven\teight\nnine ten"),
    (15, "z\nsix  seven\teight\nnine ten\nz"),
    (16, "one two three four\nz\none two three four"),
]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_same_as_brute_force(spark, docs_of, size):
    for words in (5, 50):
        got = lines.remove_repeats(docs_of(CASES), size, words).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == brute(CASES, size, words)


def test_query(spark, sf, text_of):
    got = catalog.QUERIES["op3_line_dedup"](spark, sf).collect()
    want = [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in brute(sorted(text_of.items()), 3)]
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in got) == want


def test_columns_stay_and_repeated_rows_are_one_document(spark, docs_of):
    docs = docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "n\no\np")])
    got = lines.remove_repeats(docs, 3)
    assert set(docs.columns) <= set(got.columns)
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in got.collect()) == [
        ("1", "a\nb\nc", 0), ("1", "a\nb\nc", 0), ("2", "d", 3), ("None", "n\no\np", 0),
    ]
    assert lines.remove_repeats(docs_of([]), 3).count() == 0


def test_runs_are_maximal(spark, docs_of):
    got = lines.repeated_runs(docs_of([(1, "a\nb\nc\nd\ne\nf"), (2, "x\na\nb\nc\nd\nz\nd\ne\nf")]), 3)
    assert sorted((r["doc_id"], r["start"], r["n_lines"]) for r in got.collect()) == [(2, 1, 4), (2, 6, 3)]
