"""Packing by optimal length buckets.

Sequences are padded to their bucket's length. A histogram of all lengths goes to the
driver (at most ``max_len`` counts, whatever the number of rows), where dynamic
programming finds the ``n_buckets`` boundaries with the least padding in total: the cost
of a bucket is convex in the usual sense (concave Monge), so each layer is filled by
divide and conquer. Inside a bucket of length L a batch holds ``budget // L`` sequences.

Texts longer than ``max_len`` are cut into pieces of ``max_len`` and a rest, so nothing is
dropped. Places inside a bucket come from counts of small blocks of rows and the number
inside the block, so a bucket that holds most rows is still numbered by many tasks.

Defined cases: a null or empty text has length 0 and is its own piece in the shortest
bucket; repeated rows are pieces each; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import words
from sightline.llm.sources import checkpointed


def bucket_lengths(counts: np.ndarray, n_buckets: int) -> list[int]:
    """Boundaries (inclusive, ascending) that minimise the padding of ``counts[length]``.

    Returns at most n_buckets lengths, the last one the longest that occurs.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    k = min(n_buckets, len(lengths))
    rows = np.concatenate(([0], np.cumsum(counts[lengths].astype(float))))
    # Padded volume of lengths a..b-1 in one bucket; the texts' own volume is a constant.
    cost = lambda a, b: (rows[b] - rows[a]) * lengths[b - 1]
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choices = []
    for _ in range(k):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            a = np.arange(first, min(last, mid - 1) + 1)
            total = best[a] + cost(a, mid)
            at = int(np.argmin(total))
            new[mid], arg[mid] = total[at], a[at]
            stack += [(low, mid - 1, first, int(a[at])), (mid + 1, high, int(a[at]), last)]
        best = new
        choices.append(arg)
    ends, at = [], n
    for arg in reversed(choices):
        ends.append(int(lengths[at - 1]))
        at = int(arg[at])
        if at == 0:
            break
    return ends[::-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens``: number of words of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            n = np.diff(words.of_texts(batch.column("text")).of_row())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_tokens long"
    )


def pieces(lengths: DataFrame, max_len: int) -> DataFrame:
    """``doc_id, part, start, n_tokens``: each text as pieces of at most max_len tokens."""
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(n / max_len)).cast("int")
    return (
        lengths.select("doc_id", n.alias("total"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .withColumn("start", F.col("part").cast("long") * max_len)
        .select("doc_id", "part", "start", F.least(F.lit(max_len), F.col("total") - F.col("start")).alias("n_tokens"))
    )


def pack(
    lengths: DataFrame, n_buckets: int = 16, max_len: int = 2048, budget: int = 16384, block_rows: int = 50_000
) -> DataFrame:
    """``doc_id, part, start, n_tokens, bucket_len, batch, slot, padding`` of every piece.

    lengths: ``doc_id, n_tokens``. A batch is named by its bucket and its number there;
    all its sequences are padded to ``bucket_len`` and together fit into ``budget``.
    """
    if max_len > budget:
        raise ValueError("a sequence of max_len must fit into the budget")
    cut = pieces(checkpointed(lengths.select("doc_id", "n_tokens")), max_len)  # texts are read once
    histogram = cut.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    counts = np.zeros(max_len + 1, dtype=np.int64)
    for row in histogram:
        counts[row["n_tokens"]] = row["count"]
    ends = bucket_lengths(counts, n_buckets) or [max_len]
    blocks = max(1, int(counts.sum()) // block_rows)
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, end).otherwise(bucket)
    placed = cut.withColumn("bucket_len", bucket.cast("long")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks))
    )
    # One row per bucket and block: n_buckets times rows / block_rows, small beside the rows.
    per_block = placed.groupBy("bucket_len", "block").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket_len").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("bucket_len", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_len", "block").orderBy("doc_id", "part", "n_tokens")
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1).join(offsets, ["bucket_len", "block"])
    place = F.col("offset") + F.col("number")
    capacity = F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))
    return numbered.select(
        "doc_id",
        "part",
        "start",
        "n_tokens",
        "bucket_len",
        F.floor(place / capacity).alias("batch"),
        F.pmod(place, capacity).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
