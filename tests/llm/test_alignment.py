import hashlib
from collections import Counter

import pytest

from sightline.llm import alignment, catalog

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")


def spans(text, tools):
    """Ids with the bytes they cover, of both vocabularies; None where the bytes differ."""
    a, b = tools
    letter = alignment._byte_of_character()
    whole = (" " + text).encode()
    out = []
    for tokens in (
        [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)],
    ):
        at, rows = 0, []
        for i, data in tokens:
            rows.append((i, at, at + len(data)))
            at += len(data)
        if b"".join(d for _, d in tokens) != whole:
            return None
        out.append(rows)
    return out


def brute(texts, tools):
    found = [spans(t, tools) if t else None for t in texts]
    links, groups = [], []
    for f in found:
        at = [[k for k, (_, lo, hi) in enumerate(side) for _ in range(lo, hi)] for side in f or [[], []]]  # token of each byte
        links.append([(f[0][x][0], f[1][y][0]) for x, y in set(zip(*at))])
        cuts = sorted({e for _, _, e in f[0]} & {e for _, _, e in f[1]}) if f else []
        of = lambda side, lo, hi: ",".join(str(i) for i, s, e in f[side] if lo <= s and e <= hi)  # noqa: B023, E731
        groups.append([f"{of(0, lo, hi)}|{of(1, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)])
    count = Counter(p for ls in links for p in ls)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (
            *(map(len, f) if f else (0, 0)), len(g), len(ls),
            sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls),
            hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
        )
        for f, ls, g in zip(found, links, groups)
    ]


def check(df, rows, tools):
    want = sorted(zip((i if i is not None else -1 for i, _ in rows), brute([t for _, t in rows], tools)))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r[n] for n in NAMES)) for r in df.collect())
    assert got == want


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "Hello world"), (5, "<|endoftext|> and </s>[INST] plain"), (6, "a▁b rewritten"), (7, "naïve café, 中文字 \U0001f600\U0001f601 ok"),
    (8, "  two  spaces\n\tand\r\ntabs  "), (8, "same id, other text"), (8, "same id, other text"), (None, "no id"), (None, "no id"), (9, "\x00\x01 control \x7f"),
    (10, "ab" * 3000), (11, "word " * 4000), (12, "don't it's we'll 123456 $%^&*()"), (13, "é ﬁ   \u0085 ​"),
]


def test_cases_as_brute_force(spark, docs_of, tools):
    check(alignment.align(docs_of(ROWS)), ROWS, tools)
    assert alignment.align(docs_of([])).count() == 0


def test_blocks_do_not_matter(spark, docs_of, tools, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    check(alignment.align(docs_of(ROWS).repartition(3)), ROWS, tools)


def test_query(spark, sf, text_of, tools):
    check(catalog.QUERIES["op11_cross_tokenizer_alignment"](spark, sf), sorted(text_of.items()), tools)


def test_groups_of_one_text(spark, docs_of, tools):
    text = "naïve café 中文 don't"
    (row,) = alignment.alignments(docs_of([(1, text)])).collect()
    a, b = spans(text, tools)
    assert [i for g in row["groups"] for i in g["a"]] == [i for i, _, _ in a]
    assert [i for g in row["groups"] for i in g["b"]] == [i for i, _, _ in b]
    ends = [g["end"] for g in row["groups"]]
    assert ends == sorted({e for *_, e in a} & {e for *_, e in b})
    assert [g["start"] for g in row["groups"]] == [0, *ends[:-1]]


def test_both_encoders_of_a_agree(tools):
    """Every character up to U+1FFFF in several surroundings: ranks and merges give the same ids."""
    with open(f"{alignment.FOLDER}/byte_bpe_50k.json", encoding="utf-8") as file:
        ranks = alignment.byte_level(file.read())
    step = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f" a{c}b 1{c}2 {c} {c}{c}!{c}?  {c}" for c in map(chr, step)]
    assert ranks.encode(texts) == [tools[0].encode(t, add_special_tokens=False).ids for t in texts]
