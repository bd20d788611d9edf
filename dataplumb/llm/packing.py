"""Sequences for training by powers of two: no padding, and no sequence crosses documents.

A document's ids, with an end id, are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest, larger ones first. Each piece is a sequence. Those of one length form a bucket,
whose sequences have consecutive numbers (longest bucket first), so that a batch takes a run of numbers and all of its
rows are of one length.

Steps: texts are encoded and cut in one pass, which stores the pieces, numbered for each length within their task; these
counts, one row for each task and length, are summed up to the first number of each task; pieces get theirs by a join with
that small table. Texts and ids meet no shuffle, so that no document, source or group of copies can be hot.

Defined cases: a null text is an empty one, which has the end id only; repeated and null doc_ids are documents like others; a
very long text is many pieces. Other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._blocks import text_blocks
from ._common import small, stored, tidy
from ._tokens import codec

LONGEST = 4096
#: Bytes of text that are encoded together; a longer text comes alone.
TOGETHER = 1 << 23


def cut(tokens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of so many ids, in order: number of the document, ids before in it, length."""
    docs, starts, lengths = [], [], []
    whole = tokens // longest
    docs.append(np.repeat(np.arange(len(tokens)), whole))
    starts.append((np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)) * longest)
    lengths.append(np.full(len(starts[0]), longest))
    size = longest // 2
    while size:
        found = np.flatnonzero(tokens & size)
        docs.append(found)
        starts.append(tokens[found] & ~(2 * size - 1))
        lengths.append(np.full(len(found), size))
        size //= 2
    doc, start, length = (np.concatenate(x) for x in (docs, starts, lengths))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, longest: int = LONGEST) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, start (ids of the document before), length, doc_tokens, sequence_id, offset, and ids (unsigned 32-bit numbers, little-endian)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    docs = docs.select("doc_id", "text")
    long = T.LongType()
    fields = [T.StructField("part", T.IntegerType()), T.StructField("nth", long), T.StructField("length", long), docs.schema["doc_id"], T.StructField("start", long), T.StructField("doc_tokens", long), T.StructField("ids", T.BinaryType())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_, part = codec(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            for row, end, texts, at in text_blocks(batch.column(1), TOGETHER):
                ids, counts = codec_.encode_block(texts, at)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                doc, start, length = cut(counts, longest)
                nth = np.zeros(len(doc), np.int64)
                for size in range(len(seen)):
                    here = np.flatnonzero(length == 1 << size)
                    nth[here] = seen[size] + np.arange(len(here))
                    seen[size] += len(here)
                offsets = np.append(0, np.cumsum(length)) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array(nth), pa.array(length), batch.column(0).slice(row, end - row).take(pa.array(doc)), pa.array(start), pa.array(counts[doc]), data.cast(pa.binary())],
                    names=[f.name for f in fields],
                )

    pieces = stored(docs.mapInArrow(encode, T.StructType(fields)), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    with tidy(docs.sparkSession):
        buckets = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, run = {}, 0
    for length in sorted(buckets, reverse=True):
        first[length], run = run, run + buckets[length]
    begin = F.create_map(*(F.lit(x) for kv in first.items() for x in kv)) if first else F.create_map().cast("map<bigint,bigint>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n") + F.element_at(begin, F.col("length"))
    numbered = pieces.join(small(counts.select("length", "part", before.alias("before"))), ["length", "part"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", (F.col("before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, longest: int = LONGEST) -> None:
    """The sequences as a Parquet table below path, a folder for each bucket."""
    pack(docs, tokenizer, end_id, longest).write.partitionBy("length").option("compression", "zstd").parquet(path)


def report(docs: DataFrame, tokenizer: str, end_id: int | None = 2, longest: int = LONGEST) -> DataFrame:
    """pack() with a digest of each piece's ids."""
    return pack(docs, tokenizer, end_id, longest).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
