"""Blocks of documents and shards of keys: how keys of all texts meet without a row for each.

Documents are dealt to *blocks* by a hash of their id, a block being a few megabytes of
text that one call reads. What a block has to say about its keys goes to *shards* of the
key space as packed arrays, one row per block and shard; a shard answers each block in the
same way. A key that occurs in most documents is one entry per block, so no shard grows
with the copies of a key. Blocks and shards follow the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).max


def blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``doc_id, text, block`` of every row, and fitting numbers of blocks and of shards."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).alias("block")
    return docs.select("doc_id", "text", block), n_blocks, 1 + total // SHARD_BYTES


def ids(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The rows' ids; a null id counts as larger than any other."""
    return rows.column("doc_id").fill_null(NO_ID).to_numpy()


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


def dealt(block: int, shard: np.ndarray, columns: dict[str, np.ndarray], n_shards: int) -> pa.Table:
    """One row per shard: ``block, shard`` and the shard's part of each column as bytes."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(n_shards + 1))
    some = [s for s in range(n_shards) if ends[s] < ends[s + 1]]
    made = {"block": pa.array([block] * len(some), pa.int64()), "shard": pa.array(some, pa.int64())}
    for name, values in columns.items():
        sorted_ = values[order]
        made[name] = pa.array([sorted_[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary())
    return pa.table(made)


def gathered(table: pa.Table, kinds: dict[str, type]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The packed columns of all rows in one array each, and the number of entries per row."""
    out, counts = {}, np.zeros(table.num_rows, dtype=np.int64)
    for name, kind in kinds.items():
        parts = [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        out[name] = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return out, counts


def answered(table: pa.Table, counts: np.ndarray, kept: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Each row of a shard answered with those of its entries that are kept."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    parts = {i: slice(ends[i], ends[i + 1]) for i in range(table.num_rows)}
    left = [i for i, part in parts.items() if kept[part].any()]
    made = {name: table.column(name).take(pa.array(left, pa.int64())) for name in ("block", "shard")}
    for name, values in columns.items():
        made[name] = pa.array([values[parts[i]][kept[parts[i]]].tobytes() for i in left], pa.binary())
    return pa.table(made)


def empty(columns: dict[str, type]) -> pa.Table:
    kinds = {"block": pa.int64(), "shard": pa.int64()} | {name: pa.binary() for name in columns}
    return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def schema(columns: dict[str, type]) -> str:
    return "block long, shard long, " + ", ".join(f"{name} binary" for name in columns)


def batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.combine_chunks().to_batches())
