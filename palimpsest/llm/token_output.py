"""Token ids of documents as binary blocks in doc_id order, and back.

Documents are dealt by ranges of doc_id and sorted, nulls first; each part is written as
consecutive blocks of whole documents (about BLOCK ids; a longer document makes a longer block), coded by id_coder. The container
is a table of (part, block, n_tokens, data) in the shared folder, so Spark's own writer makes it safe
against lost executors and any store will do. Parts and blocks in order, headers dropped, are the id
stream.

Null text counts as empty (the end id alone). A null doc_id comes first. Repeated rows are written each. Rows of one doc_id lie in one part. A very
long text makes one longer block. Other columns are ignored. An empty table gives no blocks and an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .id_coder import LANES, STEPS, pack_block, unpack_block
from .tokens import encoder, lots, with_end

TOKENIZER, VOCAB, END = "byte_bpe_50k.json", 50257, 0
BLOCK = LANES * STEPS
BLOCKS = "part int, block int, n_tokens long, data binary"


def write_blocks(docs: DataFrame) -> DataFrame:
    """The table of blocks, stored."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, block = TaskContext.get().partitionId(), encoder(TOKENIZER, "byte"), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, nulls, lengths, ids of runs of documents
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, block
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = pack_block(doc_ids, nulls, lengths, ids, VOCAB)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "n_tokens", "data"])
            held, size, block = [], 0, block + 1
            return row

        for b in lots(batches):
            ids, n = with_end(*enc.encode(b["text"]), END)
            doc_ids, nulls = pc.fill_null(b["doc_id"], 0).to_numpy(), pc.is_null(b["doc_id"]).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            first, base = 0, 0  # of the documents of this batch that are not held yet
            while first < len(n):
                last = int(np.searchsorted(ends, base + BLOCK - size, "right"))
                if last == first and not held:
                    last = first + 1
                if last > first:
                    held.append((doc_ids[first:last], nulls[first:last], n[first:last], ids[base : int(ends[last - 1])]))
                    size, first, base = size + int(ends[last - 1]) - base, last, int(ends[last - 1])
                if first < len(n):
                    yield out()
        if held:
            yield out()

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return stored(d.mapInArrow(each, BLOCKS), "none")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, block, data in zip(b["part"], b["block"], b["data"], strict=True):
                doc_ids, nulls, lengths, ids = unpack_block(data)
                raw, at = ids.astype("<u4"), np.concatenate(([0], np.cumsum(lengths)))
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pd.DataFrame({"part": part, "block": block, "doc_id": pd.array(doc_ids, "Int64").copy() if not nulls.any() else pd.Series(doc_ids).astype("Int64").mask(nulls), "at": at[:-1], "n_tokens": lengths, "ids_crc32": crc})

    rows = blocks.select("part", "block", "data").mapInPandas(each, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = stored(blocks.select("part", "block", "n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    own = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.join(parts.select("part", before.alias("before")), "part").select("part", "block", (F.col("before") + own).alias("base"))
    return rows.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
