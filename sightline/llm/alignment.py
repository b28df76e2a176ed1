"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each text is encoded by a byte-level vocabulary A and a sentence-piece vocabulary B; both cut
the same bytes (a space, then the text). Interval coalescing: all tokens of a slice of texts
are lexsorted by start, ``maximum.accumulate`` runs over their ends, and a group ends where a
start reaches the running maximum, that is where A and B tokens both end. Inside the groups
every overlap of an A and a B token is a link; a pair of ids counts as often as the corpus
links it.

1. Slices of about a megabyte (*blocks*) are encoded and aligned, and written out: a row per
   document with each link as the place of its pair, and the block's distinct id pairs in rows
   of some thousand. So no text is encoded twice, and equal or missing ids never meet in one group.
2. Pairs are counted over all blocks, with the highest count of every B id.
3. Each block asks for the counts of its own pairs and adds them up per document. A pair is one
   row per block, however often it occurs.

Defined cases: texts that are null or empty, or whose A or B bytes differ from space and text
(a B vocabulary that rewrites characters), have no tokens: zeros and an empty digest; every row
is a document of its own, also with a repeated or null id; special tokens' strings are plain
text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import words
from sightline.llm.sources import stored

FOLDER = "/opt/tokenizers"
BLOCK_BYTES = 1 << 20
ROW_PAIRS = 4096
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: Fixed value: how byte-level vocabularies of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """encode: lists of ids of texts; tokens: the bytes of each id; lengths: of these bytes."""

    encode: object
    tokens: pa.Array
    lengths: np.ndarray


def _vocabulary(encode, tokens: list[bytes]) -> Vocabulary:
    return Vocabulary(encode, pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], dtype=np.int64))


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write visible bytes as themselves and the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(model: str) -> Vocabulary:
    """A byte-level vocabulary from its JSON text.

    Where its merges are in order of the ids they make, ids are ranks, and tiktoken gives the
    same ids in a third of the time; otherwise the tokenizers library encodes.
    """
    data = json.loads(model)
    ids, special = data["model"]["vocab"], {t["content"] for t in data["added_tokens"]}
    bytes_of = _byte_of_character()
    plain = {i: bytes(bytes_of[c] for c in t) for t, i in ids.items() if t not in special}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
    splitter = data.get("pre_tokenizer") or {}
    as_ranks = (
        [ids.get(t) for t in made] == list(range(256, 256 + len(made)))
        and len(plain) == 256 + len(made)
        and data.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex")
        and not splitter.get("add_prefix_space")
    )
    if as_ranks:
        import tiktoken

        ranks = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={t: i for i, t in plain.items()}, special_tokens={})
        encode = lambda texts: [ranks.encode_ordinary(t) for t in texts]
    else:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(model)
        tokenizer.encode_special_tokens = True
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _vocabulary(encode, [plain.get(i, b"") for i in range(max(plain) + 1)])


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Vocabulary:
    """A sentence-piece vocabulary from its model's bytes."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    as_bytes = [
        bytes([int(t[1:-1], 16)]) if processor.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)
    ]
    return _vocabulary(lambda texts: processor.encode(texts, num_threads=1), as_bytes)


class Aligned(NamedTuple):
    """Tokens of the texts in order of start (A before B), with their group; bounds by text.

    side: 0 for A, 1 for B; of_text: bounds of each text's tokens; links: places of the linked
    A and B tokens, in order of A, with the text of each.
    """

    side: np.ndarray
    token: np.ndarray
    start: np.ndarray
    end: np.ndarray
    group: np.ndarray
    of_text: np.ndarray
    counts: dict[str, np.ndarray]
    link_a: np.ndarray
    link_b: np.ndarray
    link_text: np.ndarray


def _encoded(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has."""
    ids = vocabulary.encode(texts)
    counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum())), counts


def _joined(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each text's tokens."""
    data = vocabulary.tokens.take(pa.array(ids)).buffers()[2]
    ends = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
    view = memoryview(data) if data else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def aligned(texts: pa.Array, a: Vocabulary, b: Vocabulary) -> Aligned:
    """Tokens, groups and links of all texts."""
    asked = [" " + t if t else None for t in texts.to_pylist()]
    spaced = [t for t in asked if t]
    ids_a, n_a = _encoded(a, spaced)
    ids_b, n_b = _encoded(b, [t[1:] for t in spaced])
    same = np.array(
        [x == t.encode() == y for t, x, y in zip(spaced, _joined(a, ids_a, n_a), _joined(b, ids_b, n_b))], dtype=bool
    )
    ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
    has = np.array([t is not None for t in asked], dtype=bool)
    per_a, per_b = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
    per_a[has], per_b[has] = n_a * same, n_b * same

    # The texts' bytes one after the other: A and B both end at every text's end.
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    start_a, start_b = end_a - a.lengths[ids_a], end_b - b.lengths[ids_b]
    token, start, end = np.concatenate((ids_a, ids_b)), np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(ids_a), len(ids_b)])
    order = np.lexsort((start,))  # stable: A before B at the same start
    token, start, end, side = token[order], start[order], end[order], side[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
    group = np.cumsum(opens) - 1

    # Overlaps: of each A token, the B tokens that end after its start and start before its end.
    first = np.searchsorted(end_b, start_a, side="right")
    n_over = np.searchsorted(start_b, end_a, side="left") - first
    link_a = np.repeat(np.arange(len(ids_a)), n_over)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n_over) - n_over, n_over) + np.repeat(first, n_over)

    of_text = np.concatenate(([0], np.cumsum(per_a + per_b)))
    text_a = np.repeat(np.arange(len(asked)), per_a)
    link_text = text_a[link_a]
    counts = {
        "n_a": per_a,
        "n_b": per_b,
        "n_groups": np.diff(np.concatenate(([0], np.cumsum(opens)))[of_text]),
        "n_links": np.bincount(link_text, minlength=len(asked)),
    }
    return Aligned(side, token, start, end, group, of_text, counts, ids_a[link_a], ids_b[link_b], link_text)


@lru_cache(maxsize=2)
def _decimals(n: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for i in range(n) for mark in ",|;"], pa.large_string())


def group_texts(found: Aligned, n_ids: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: ids (below n_ids) of the groups' tokens."""
    if not len(found.token):
        return [b""] * (len(found.of_text) - 1)
    part = 2 * found.group + found.side
    order = np.argsort(part, kind="stable")
    part, token = part[order], found.token[order]
    last = np.append(part[1:] != part[:-1], True)
    codes = 3 * token + np.where(last, 1 + (part & 1), 0)
    written = _decimals(n_ids).take(pa.array(codes))
    _, offsets, data = written.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[found.of_text].tolist()
    view = memoryview(data)
    return [bytes(view[x : max(x, y - 1)]) for x, y in zip(ends[:-1], ends[1:])]


def _models(spark, a_file: str, b_file: str):
    """Both vocabularies' files (a few megabytes), read on the driver, for all executors."""
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def alignments(docs: DataFrame, a_file: str = f"{FOLDER}/byte_bpe_50k.json", b_file: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """``doc_id, groups`` of every row: of each group its ids of A and of B, and its bytes of space and text."""
    models = _models(docs.sparkSession, a_file, b_file)
    kind = pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "start": pa.int64(), "end": pa.int64()}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(models.value[0]), pieces(models.value[1])
        for batch in words.slices(batches, "text"):
            found = aligned(batch.column("text"), a, b)
            rows = []
            for lo, hi in zip(found.of_text[:-1].tolist(), found.of_text[1:].tolist()):
                cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(found.group[lo:hi]))).tolist(), hi] if hi > lo else []
                groups = []
                for x, y in zip(cuts, cuts[1:]):
                    of_a = found.side[x:y] == 0
                    ids = found.token[x:y]
                    span = {"start": int(found.start[x] - found.start[lo]), "end": int(found.end[x:y].max() - found.start[lo])}
                    groups.append({"a": ids[of_a].tolist(), "b": ids[~of_a].tolist(), **span})
                rows.append(groups)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    group = "struct<a: array<int>, b: array<int>, start: long, end: long>"
    return _rows(docs).mapInArrow(read, f"doc_id long, groups array<{group}>")


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that hold the given stretches of an array."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _blocks(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows of documents (``pair`` null) and of pairs (``link`` null) of every slice.

    link: for each link the place of its pair in the block; pair, n: ids and counts of the pairs from place ``first`` on.
    """
    models = _models(docs.sparkSession, a_file, b_file)
    counts = {name: pa.int64() for name in COUNTS}
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), **counts, "groups_sha256": pa.string(), "link": pa.binary()}
    kinds |= {"first": pa.int64(), "pair": pa.binary(), "n": pa.binary()}

    def rows(columns: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(size, kind)) for k, kind in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(models.value[0]), pieces(models.value[1])
        task, n_ids = TaskContext.get().partitionId(), max(len(a.lengths), len(b.lengths))
        for number, batch in enumerate(words.slices(batches, "text", BLOCK_BYTES)):
            found = aligned(batch.column("text"), a, b)
            block = (task << 32) | number
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(found, n_ids)]
            pair, link, n = np.unique((found.link_a << 32) | found.link_b, return_inverse=True, return_counts=True)
            ends = np.concatenate(([0], np.cumsum(found.counts["n_links"])))
            columns = {name: pa.array(found.counts[name], pa.int64()) for name in COUNTS}
            columns |= {"doc_id": batch.column("doc_id"), "groups_sha256": pa.array(digests, pa.string()), "link": _packed(link.astype(np.int32), ends)}
            yield rows(columns | {"block": pa.array(np.full(batch.num_rows, block))}, batch.num_rows)
            cuts = np.append(np.arange(0, len(pair), ROW_PAIRS), len(pair))
            size = len(cuts) - 1
            columns = {"block": pa.array(np.full(size, block)), "first": pa.array(cuts[:-1]), "pair": _packed(pair, cuts), "n": _packed(n, cuts)}
            yield rows(columns, size)

    counts = ", ".join(f"{name} long" for name in COUNTS)
    schema = f"block long, doc_id long, {counts}, groups_sha256 string, link binary, first long, pair binary, n binary"
    return _rows(docs).mapInArrow(read, schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """``block, place, a, b, n`` of every block's pairs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, n = np.frombuffer(row["pair"], dtype=np.int64), np.frombuffer(row["n"], dtype=np.int64)
                columns = [np.full(len(pair), row["block"]), np.arange(row["first"], row["first"] + len(pair), dtype=np.int32)]
                columns += [(pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "a", "b", "n"])

    asked = blocks.where("pair IS NOT NULL").select("block", "first", "pair", "n")
    return asked.mapInArrow(read, "block long, place int, a int, b int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, n, best``: links that hold each pair of ids; whether no other pair of b has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str = f"{FOLDER}/byte_bpe_50k.json", b_file: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    blocks = stored(_blocks(docs, a_file, b_file), "alignment")
    pairs = _pairs(blocks)
    told = pairs.drop("n").join(pair_counts(pairs), ["a", "b"]).select("block", "place", "n", "best")

    def add(rows: pa.Table, facts: pa.Table) -> pa.Table:
        place = facts.column("place").to_numpy()
        n, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        n[place], best[place] = facts.column("n").to_numpy(), pc.cast(facts.column("best"), pa.int64()).to_numpy()
        link = np.frombuffer(b"".join(rows.column("link").to_pylist()), dtype=np.int32)
        ends = np.concatenate(([0], np.cumsum(rows.column("n_links").to_numpy())))
        sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(x[link])))[ends])) for x in (best, n)]
        kept = rows.select(["doc_id", *COUNTS])
        return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1]).append_column("groups_sha256", rows.column("groups_sha256"))

    columns = ", ".join(f"{name} long" for name in ["doc_id", *COUNTS, "n_best", "count_sum"])
    documents = blocks.where("link IS NOT NULL").drop("first", "pair", "n")
    by_block = documents.groupBy("block").cogroup(told.groupBy("block"))
    return by_block.applyInArrow(add, f"{columns}, groups_sha256 string")
