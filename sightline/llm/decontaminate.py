"""Benchmark decontamination by templates.

Texts and benchmark items become sequences of typed tokens: numbers, units after a number
and names (capitalised inside a sentence) turn into placeholders, other words are
lower-cased and lose punctuation at their ends. Windows of ``size`` tokens of the items (the
whole item, if shorter) are joined with the windows of all texts by hash. Matches along
one alignment of a document and an item are evidence together; what fills the item's
slots must be filled consistently: equal values by equal values, different numbers or
names by different ones. So a question asked again with other numbers is found, and a
text that only shares a pattern of slots is not. Where an alignment is inconsistent, its
verbatim windows (every slot holds the item's own value) still count.

A document is contaminated by an item if consistent matches cover ``least_cover`` of the
item's words, if consistent and verbatim ones together cover ``least_verbatim``, or if
either hold ``long_run`` words in a row. Windows need ``least_literals`` words that
are no placeholders (all but one, in shorter ones).

The hashes of at most ``block_windows`` benchmark windows at a time go to the executors to
pick matching windows while texts are read; a larger benchmark is matched in blocks.

Defined cases: null and empty texts and items match nothing; repeated documents are each
found; repeated items are each reported; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import words

# Units that turn into a placeholder after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mile", "miles", "meter", "meters",
    "metre", "metres", "kilometers", "kilometres", "mg", "g", "kg", "t", "gram", "grams", "kilograms", "lb", "lbs",
    "pounds", "oz", "ounces", "tons", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallons", "s", "sec",
    "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "percent", "dollars", "euros", "cents", "usd", "eur", "gbp", "degrees", "watts",
    "kw", "w", "v", "volts", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "mph", "kmh",
)
_TYPES = words.mix(np.array([101, 102, 103], dtype=np.uint64))  # number, unit, name
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?:;"]] = True
WINDOW_COLUMNS = "hash long, at int, size int, slots array<long>"


def template(raw: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hash of its typed token, whether it is a slot, and hash of the word itself."""
    w = words.stripped(raw)
    n = len(w.row)
    if not n:
        return w.hash, np.zeros(0, dtype=bool), w.hash
    data, first = w.data, w.data[w.start]
    second = data[np.minimum(w.start + 1, len(data) - 1)]
    number = words.DIGIT[first] | (np.isin(data[raw.start], np.frombuffer(b"+-$", dtype=np.uint8)) & words.DIGIT[second])
    opens = np.ones(n, dtype=bool)  # a sentence: first word, after an end mark, or on a new line
    opens[1:] = (w.row[1:] != w.row[:-1]) | _SENTENCE_END[data[raw.end[:-1] - 1]] | (data[raw.start[1:] - 1] == 10)
    after_number = np.zeros(n, dtype=bool)
    after_number[1:] = number[:-1] & (w.row[1:] == w.row[:-1])
    unit = after_number & np.isin(w.hash, words.of_texts(pa.array(UNITS), lower=True).hash)
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~opens & ~number & ~unit
    token = w.hash.copy()
    for mask, kind in zip((number, unit, name), _TYPES):
        token[mask] = kind
    return token, number | unit | name, w.hash


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def item_windows(items: DataFrame, size: int, least_literals: int) -> DataFrame:
    """``item_id, n_words, hash, at, size, slots`` of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            raw = words.of_texts(batch.column("text"))
            token, slot, value = template(raw)
            bounds, ids = raw.of_row(), batch.column("item_id").to_pylist()
            rows = []
            for i, item in enumerate(ids):
                a, b = int(bounds[i]), int(bounds[i + 1])
                own = min(size, b - a)
                if not own:
                    continue
                hashes = _as_long(words.windows(token[a:b], own))
                for at, h in enumerate(hashes.tolist()):
                    inside = slot[a + at : a + at + own]
                    if own - inside.sum() >= min(least_literals, max(own - 1, 1)):
                        slots = _as_long(np.where(inside, value[a + at : a + at + own], 0)).tolist()
                        rows.append((item, b - a, h, at, own, slots))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            names = ["item_id", "n_words", "hash", "at", "size", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    read = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(cut, "item_id long, n_words int, " + WINDOW_COLUMNS)


def matching_windows(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """``doc_id, hash, at, size, slots`` of the texts' windows whose hash is wanted (by size)."""
    sent = docs.sparkSession.sparkContext.broadcast({n: np.sort(h) for n, h in wanted.items()})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for n, hashes in sent.value.items():  # a table of bits first: few windows pass it by chance
            bits = max(16, int(len(hashes) * 64).bit_length())
            table = np.zeros(1 << bits, dtype=bool)
            table[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            tables[n] = (hashes, table, np.uint64((1 << bits) - 1))
        for batch in words.slices(batches, "text"):
            raw = words.of_texts(batch.column("text"))
            token, slot, value = template(raw)
            for n, (hashes, table, mask) in tables.items():
                found = words.windows(token, n)
                at = np.flatnonzero(table[(found & mask).astype(np.int64)])
                at = at[raw.row[at] == raw.row[at + n - 1]]
                place = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
                at = at[hashes[place] == found[at]]
                if not len(at):
                    continue
                reach = at[:, None] + np.arange(n)
                slots = _as_long(np.where(slot[reach], value[reach], np.uint64(0))).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(slots) + 1, n, dtype=np.int32), pa.array(slots))
                row = raw.row[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        pa.array(_as_long(found[at])),
                        pa.array((at - raw.of_row()[row]).astype(np.int32)),
                        pa.array(np.full(len(at), n, dtype=np.int32)),
                        lists,
                    ],
                    ["doc_id", "hash", "at", "size", "slots"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(pick, "doc_id long, " + WINDOW_COLUMNS)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 8,
    least_literals: int = 4,
    least_cover: float = 0.5,
    long_run: int = 13,
    block_windows: int = 1_000_000,
    least_verbatim: float = 0.9,
) -> DataFrame:
    """``doc_id, item_id, cover, run, doc_at``: the items that documents repeat.

    cover: share of the item's words in consistent or verbatim matches; run: longest stretch
    of words; doc_at: the first matching word of the document.
    """
    benchmark = item_windows(items, size, least_literals)
    n_blocks = 1 + benchmark.count() // block_windows
    matched = None
    for block in range(n_blocks):
        part = benchmark.where(F.pmod("hash", F.lit(n_blocks)) == block)
        hashes = part.select("size", "hash").distinct().collect()  # about block_windows at most
        wanted: dict[int, list[int]] = {}
        for row in hashes:
            wanted.setdefault(row["size"], []).append(row["hash"])
        found = matching_windows(docs, {n: np.array(h, dtype=np.int64).view(np.uint64) for n, h in wanted.items()})
        joined = found.join(
            part.select("item_id", "n_words", "hash", "size", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")),
            ["hash", "size"],
        )
        matched = joined if matched is None else matched.unionByName(joined)
    pairs = F.filter(
        F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("item"), d.alias("doc"))),
        lambda p: (p["item"] != 0) | (p["doc"] != 0),
    )
    # One alignment: the item lies over the document at one shift.
    lines = (
        matched.select(
            "doc_id", "item_id", "n_words", "size", "item_at", "at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"),
            (F.col("slots") == F.col("item_slots")).alias("verbatim"),
        )
        .groupBy("doc_id", "item_id", "n_words", "shift")
        .agg(
            F.sort_array(F.collect_set(F.struct("item_at", "size"))).alias("windows"),
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
            F.min("at").alias("doc_at"),
            F.sort_array(F.collect_set(F.when(F.col("verbatim"), F.struct("item_at", "size")))).alias("verbatim"),
            F.min(F.when(F.col("verbatim"), F.col("at"))).alias("verbatim_at"),
        )
    )
    values = lambda side: F.size(F.array_distinct(F.col("pairs")[side]))
    whole = (values("item") == F.size("pairs")) & (values("doc") == F.size("pairs"))
    evidence = lines.select(
        "doc_id", "item_id", "n_words", whole.alias("whole"),
        F.when(whole, F.col("windows")).otherwise(F.col("verbatim")).alias("windows"),
        F.when(whole, F.col("doc_at")).otherwise(F.col("verbatim_at")).alias("doc_at"),
    ).where(F.size("windows") > 0)
    covered = F.array_distinct(
        F.flatten(F.transform("windows", lambda w: F.sequence(w["item_at"], w["item_at"] + w["size"] - 1)))
    )
    run = F.aggregate(
        "words",
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, w: F.struct(
            w.alias("last"),
            F.when(w == acc["last"] + 1, acc["now"] + 1).otherwise(1).alias("now"),
            F.greatest(acc["best"], F.when(w == acc["last"] + 1, acc["now"] + 1).otherwise(1)).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    scored = evidence.select("doc_id", "item_id", "n_words", "whole", "doc_at", F.sort_array(covered).alias("words")).select(
        "doc_id", "item_id", "n_words", "whole", "doc_at", "words", run.alias("run")
    )
    distinct = lambda words: F.size(F.array_distinct(F.flatten(F.collect_set(words))))
    return (
        scored.groupBy("doc_id", "item_id", "n_words")
        .agg(
            distinct(F.col("words")).alias("covered"),
            distinct(F.when(F.col("whole"), F.col("words"))).alias("consistent"),
            F.max("run").alias("run"),
            F.min("doc_at").alias("doc_at"),
        )
        .withColumn("cover", F.col("covered") / F.col("n_words"))
        .where(
            (F.col("consistent") / F.col("n_words") >= least_cover)
            | (F.col("cover") >= least_verbatim)
            | (F.col("run") >= long_run)
        )
        .select("doc_id", "item_id", "cover", "run", "doc_at")
    )
