"""Token ids in files: ranked by frequency, in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank (the most frequent one is 0; ties by id), so that most take one byte. A rank takes 1 to
4 bytes, least significant first; its length less one stands in two bits of a control byte, four ranks to each. Control
bytes and data bytes are apart, and reading looks the lengths of four ranks up in a table of 256 rows.

A segment is one file: a row (name, content) of a Parquet table in any store that Spark writes to, with the commit
protocol and compression of Spark's writer. Names ascend with doc_id, as do documents in a segment. Layout of
content, little-endian: HEADER (magic, version, documents, ids, ids of all documents before, data bytes); doc_id int64
and null flag uint8 of each document; number of ids of each, uint32; control bytes; data bytes. Beside the segments lies
the table of ranks (rank, id, n).

Steps: texts are encoded once and dealt by ranges of doc_id, whose bounds come from quantiles; a table of them, in order
and numbered, gives the counts of ids and of each range; then segments are written range by range without another
shuffle. The driver gets a row for each id of the vocabulary and one for each range.

Defined cases: a null text is an empty one and gets the end id only; null doc_ids come first; repeated doc_ids follow
each other, by ids; a long text is one segment. doc_id must be a whole number. Empty tables give an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import text_blocks
from ._common import drop_stored, fresh_path, release, stored
from ._tokens import codec

MAGIC, VERSION = b"DPTK", 1
HEADER = struct.Struct("<4sHIQQQ")
#: A segment ends after the document that brings it to so many ids.
SEGMENT = 1 << 17
#: Bytes of text that are encoded together; a longer text comes alone.
TOGETHER = 1 << 23

#: Lengths of the four ranks of each control byte; and what of four bytes belongs to a rank of each length.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    four[: len(ranks)] = size - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    value = raw[begin] | raw[begin + 1] << 8 | raw[begin + 2] << 16 | raw[begin + 3] << 24 if n else np.zeros(0, np.uint32)
    return value & MASKS[size]


def segment(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray, start: int) -> bytes:
    control, data = pack(ranks)
    parts = [HEADER.pack(MAGIC, VERSION, len(doc_ids), len(ranks), start, len(data)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array(counts, "<u4").tobytes(), control, data]
    return b"".join(parts)


def read_segment(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, their numbers of ids, ranks of all ids, ids of all documents before."""
    magic, version, docs, n, start, n_data = HEADER.unpack_from(content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment of this version")
    at = HEADER.size
    ids = np.frombuffer(content, "<i8", docs, at).tolist()
    nulls = content[at + 8 * docs : at + 9 * docs]
    counts = np.frombuffer(content, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    control = content[at : at + (n + 3) // 4]
    at += (n + 3) // 4
    return [None if null else i for i, null in zip(ids, nulls, strict=True)], counts, unpack(control, content[at : at + n_data], n), start


def _flat(data: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one behind the other, and where each row's begin (and the last one's end)."""
    data = data.cast(pa.large_binary())
    if not len(data):
        return np.zeros(0, width), np.zeros(1, np.int64)
    _, at, raw = data.buffers()
    at = np.frombuffer(at, np.int64)[data.offset : data.offset + len(data) + 1]
    ids = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(width) if raw is not None else np.zeros(0, width)
    return ids, (at - at[0]) // width.itemsize


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0) -> None:
    """Encode docs(doc_id, text), append end_id to each document, and write segments and ranks below path."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    quantiles = [k / n_parts for k in range(1, n_parts)]
    bounds = np.array((quantiles and docs.agg(F.percentile_approx("doc_id", quantiles, 100 * n_parts)).first()[0]) or [], np.int64)
    width = codec(tokenizer).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(tokenizer)
        for batch in batches:
            for row, end, texts, at in text_blocks(batch.column(1), TOGETHER):
                doc_ids = batch.column(0).slice(row, end - row)
                part = np.searchsorted(bounds, doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)).astype(np.int32)
                ids, counts = codec_.encode_block(texts, at)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                offsets = np.append(0, np.cumsum(counts)) * width.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(width))])
                yield pa.RecordBatch.from_arrays([pa.array(part), doc_ids, data.cast(pa.binary())], names=["part", "doc_id", "data"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = start = 0
        for batch in batches:
            counts = np.diff(_flat(batch.column(2), width)[1])
            starts = start + np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(nth, nth + len(counts))), pa.array(starts), pa.array(counts)], names=["part", "doc_id", "data", "nth", "start", "n"])
            nth, start = nth + len(counts), start + int(counts.sum())

    encoded = docs.mapInArrow(encode, "part int, doc_id long, data binary")
    encoded = encoded.repartitionById(n_parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "data")
    encoded = stored(encoded.mapInArrow(number, "part int, doc_id long, data binary, nth long, start long, n long"), "encoded")
    release(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column(0), width)[0], minlength=len(total))
            found[: len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    counted = encoded.select("data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counted = counted.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    size = max(codec(tokenizer).size, int(counted["id"].max()) + 1 if len(counted) else 1, (end_id or 0) + 1)
    rank_of = np.zeros(size, np.uint32)
    rank_of[counted["id"].to_numpy(np.int64)] = np.arange(len(counted), dtype=np.uint32)
    counted.insert(0, "rank", range(len(counted)))
    spark.createDataFrame(counted, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    totals = dict(encoded.groupBy("part").agg(F.sum("n")).collect())
    before, run = {}, 0
    for part in sorted(totals):
        before[part], run = run, run + totals[part]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, nth, start, n = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            every, at = _flat(batch.column(2), width)
            names, contents, first = [], [], 0
            held = 0
            for k in range(len(part)):
                held += n[k]
                if k + 1 < len(part) and part[k + 1] == part[k] and nth[k + 1] == nth[k] + 1 and held < SEGMENT:
                    continue
                ranks = rank_of[every[at[first] : at[k + 1]]]
                names.append(f"part-{part[first]:06d}-{nth[first]:012d}")
                contents.append(segment(ids[first : k + 1], n[first : k + 1], ranks, before[part[first]] + start[first]))
                first, held = k + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    encoded.mapInArrow(build, "name string, content binary").write.option("compression", "zstd").parquet(f"{path}/segments")
    drop_stored(encoded)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or with digest their ids_crc32) of every document in the segments below path."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    id_of = ranks["id"].to_numpy("<u4") if len(ranks) else np.zeros(1, "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                docs, counts, found, start = read_segment(content.as_py())
                ids = id_of[found]
                ends = np.cumsum(counts)
                begins = ends - counts
                if digest:
                    last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:] if len(ends) else 0).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + begins), pa.array(counts), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return spark.read.parquet(f"{path}/segments").select("content").mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Write docs' ids to files in the shared folder and read back what they hold, with digests."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path, digest=True)
