"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the bytes cuts texts where its top bits are zero, so that equal passages are cut alike wherever they
stand. Chunks found twice or more are encoded once. In each document what stands between two shared chunks is
encoded anew, with the end of the one and the beginning of the other: that window is widened, one space at a time, until
the ids of a still wider one agree exactly with it and with the chunks' own ids outside of it.

Steps: (1) one row for each chunk's 128-bit digest, summed; (2) a bitmap of the digests found twice or more, of at most
BITMAP_BITS bits, so that what is sent to the tasks is bounded: where it fills up, more chunks are treated as shared,
which changes the work and not the ids; (3) documents without shared chunks are done at once, the others become windows
and references, and each chunk's text goes out once a batch; (4) each chunk's text is encoded once; (5) references
get their ids by a join on the digest and documents are put together in order, as a stream.

Defined cases: a null text is an empty one (no ids); repeated or null ids are no matter, as rows are numbered for
themselves; very long texts are many chunks. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import text_blocks
from ._common import release, stored
from ._tokens import Codec, codec

#: A chunk has 2 ** CUT_BITS bytes in the mean; WINDOW bytes decide on a cut; shorter than SHORTEST aren't shared.
CUT_BITS, WINDOW, SHORTEST = 9, 32, 96
BITMAP_BITS = 1 << 26
_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
_FACTOR = 0x9E3779B1
#: A place where the text can be cut without touching a token: before white space that follows something else.
_CUT = re.compile(r"(?<=[^ \t\n\r])[ \t\n\r]")


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of chunks by the rolling hash of the WINDOW bytes before, never inside a character."""
    h, width, factor = _GEAR[data], 1, _FACTOR
    while width < WINDOW:
        h[width:] = h[width:] + np.uint32(factor) * h[:-width]
        factor = factor * factor & 0xFFFFFFFF
        width *= 2
    found = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    found = found[found < len(data)]
    return found[(data[found] & 0xC0) != 0x80]


def chunks(data: np.ndarray, at: np.ndarray) -> Iterator[list[bytes]]:
    """The chunks of each text. The hash is that of the text alone: its first WINDOW bytes end no chunk."""
    found = cuts(data)
    first = np.searchsorted(found, at[:-1] + WINDOW)
    last = np.searchsorted(found, at[1:])
    raw = data.tobytes()
    for i in range(len(at) - 1):
        ends = [int(at[i]), *found[first[i] : last[i]].tolist(), int(at[i + 1])]
        yield [raw[a:b] for a, b in itertools.pairwise(ends) if b > a]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_KEYS = "a long, b long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[bytes] = Counter()
        for _, _, data, at in text_blocks(batch.column(0)):
            for parts in chunks(data, at):
                seen.update(xxhash.xxh3_128_digest(x) for x in parts if len(x) >= SHORTEST)
        halves = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])


def bitmap(docs: DataFrame) -> np.ndarray:
    """Bits of the digests of chunks found twice or more."""
    keys = docs.select("text").mapInArrow(_count, _KEYS).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.pmod(F.col("a"), F.lit(BITMAP_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(a, {BITMAP_BITS}) % 64 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def _shared(chunk: bytes, key: tuple[int, int], bits: np.ndarray) -> bool:
    place = key[0] % BITMAP_BITS
    return bool(bits[place >> 6] >> (place & 63) & 1)


class _Side:
    """One end of a shared chunk: cut places from the join outwards."""

    def __init__(self, text: str, places: list[int], codec_: Codec, right: bool):
        self.text, self.places, self.codec, self.right, self.k = text, places, codec_, right, 0

    def near(self, k: int) -> str:
        return self.text[: self.places[k]] if self.right else self.text[self.places[k] :]

    def between(self, k: int) -> str:
        """What a window widened from k to k + 1 takes in."""
        return self.text[self.places[k] : self.places[k + 1]] if self.right else self.text[self.places[k + 1] : self.places[k]]

    def agrees(self, k: int) -> bool:
        parts = [self.codec.encode(self.near(k)), self.codec.encode(self.between(k))]
        return b"".join(parts if self.right else parts[::-1]) == self.codec.encode(self.near(k + 1))


def window(left: _Side | None, middle: str, right: _Side | None, codec_: Codec) -> tuple[bytes, int, int] | None:
    """Ids of the middle with the ends next to it, and how many of the left and right chunks' ids they replace.

    None: no window agrees.
    """
    sides = [s for s in (left, right) if s]
    k = 0
    while all(k + 1 < len(s.places) for s in sides):
        now = codec_.encode((left.near(k) if left else "") + middle + (right.near(k) if right else ""))
        wide = codec_.encode((left.near(k + 1) if left else "") + middle + (right.near(k + 1) if right else ""))
        around = (codec_.encode(left.between(k)) if left else b"") + now + (codec_.encode(right.between(k)) if right else b"")
        if wide == around and all(s.agrees(k) for s in sides):
            return now, codec_.count(codec_.encode(left.near(k))) if left else 0, codec_.count(codec_.encode(right.near(k))) if right else 0
        k += 1
    return None


def _pieces(parts: list[bytes], shared: list[bool], codec_: Codec) -> list[tuple[bytes, int, int] | int] | None:
    """The document as ids with counts to drop, in turn with the numbers of shared chunks; None: no chunk can stay."""
    while any(shared):
        texts, places = {}, {}
        for i, flag in enumerate(shared):
            if flag:
                texts[i] = parts[i].decode()
                places[i] = [m.start() for m in _CUT.finditer(texts[i])]
                shared[i] = len(places[i]) >= 6
        out, middle, left, failed = [], [], None, None
        for i in [*range(len(parts)), None]:
            if i is not None and not shared[i]:
                middle.append(parts[i])
                continue
            ends = _Side(texts[left], places[left][: len(places[left]) // 2 - 1 : -1], codec_, False) if left is not None else None
            begins = _Side(texts[i], places[i][: len(places[i]) // 2], codec_, True) if i is not None else None
            if ends is None and begins is None:
                return None
            found = window(ends, b"".join(middle).decode(), begins, codec_)
            if found is None:
                failed = [x for x in (left, i) if x is not None]
                break
            out += [found] if i is None else [found, i]
            middle, left = [], i
        if failed is None:
            return out
        for i in failed:
            shared[i] = False
    return None


_DONE, _IDS, _REFERENCE, _CHUNK = range(4)


def _schema(doc_id: T.StructField, fields: list[T.StructField]) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("uid", long), T.StructField("doc_id", doc_id.dataType), T.StructField("seq", long), T.StructField("a", long), T.StructField("b", long), T.StructField("head", long), T.StructField("tail", long), T.StructField("data", T.BinaryType()), *fields])


FINISHED = {
    "digest": [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())],
    "ids": [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())],
}


def _finish(data: bytes, codec_: Codec, output: str) -> tuple:
    if output == "ids":
        return codec_.ids(data).tolist(), codec_.decode(data).decode()
    return codec_.count(data), hashlib.sha256(codec_.decimal(data)).hexdigest(), hashlib.sha256(codec_.decode(data)).hexdigest()


def encode(docs: DataFrame, tokenizer: str, output: str = "digest") -> DataFrame:
    """doc_id with n_tokens and the digests of ids and decoded text, or (output="ids") with the ids and the decoded text."""
    spark, bits = docs.sparkSession, None
    bits = spark.sparkContext.broadcast(bitmap(docs))
    release(spark)
    docs = docs.select("doc_id", "text")
    schema = _schema(docs.schema["doc_id"], FINISHED[output])
    arrow = _arrow(schema)
    blank = (None,) * len(FINISHED[output])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_, uid = codec(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sent = batch.column(0).to_pylist(), set()
            for row, _, data, at in text_blocks(batch.column(1)):
                rows = []
                codec_.learn_from(data.tobytes().decode())
                for i, parts in enumerate(chunks(data, at), row):
                    uid += 1
                    keys = [_halves(xxhash.xxh3_128_digest(x)) if len(x) >= SHORTEST else None for x in parts]
                    shared = [k is not None and _shared(x, k, bits.value) for x, k in zip(parts, keys, strict=True)]
                    made = _pieces(parts, shared, codec_) if any(shared) else None
                    if made is None:
                        rows.append((_DONE, uid, ids[i], 0, None, None, None, None, None, *_finish(codec_.encode(b"".join(parts).decode()), codec_, output)))
                        continue
                    # The chunk's own ids from `head` on, without the last `tail`.
                    for seq, x in enumerate(made):
                        if isinstance(x, int):
                            head, tail = made[seq - 1][2], made[seq + 1][1]
                            rows.append((_REFERENCE, uid, ids[i], seq, *keys[x], head, tail, None, *blank))
                            if keys[x] not in sent:
                                sent.add(keys[x])
                                rows.append((_CHUNK, None, None, None, *keys[x], None, None, parts[x], *blank))
                        else:
                            rows.append((_IDS, uid, ids[i], seq, None, None, 0, 0, x[0], *blank))
                yield _batch(rows, arrow)

    cut_up = stored(docs.mapInArrow(cut, schema), "pieces")

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_, last = codec(tokenizer), None
        for batch in batches:
            rows = []
            for a, b, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (a, b) != last:
                    last = a, b
                    rows.append((a, b, codec_.encode(data.decode())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "chunk"])

    texts = cut_up.where(F.col("kind") == _CHUNK).select("a", "b", "data").repartition("a", "b").sortWithinPartitions("a", "b")
    encoded = texts.mapInArrow(encode_chunks, "a long, b long, chunk binary")
    columns = ["uid", "doc_id", "seq", "head", "tail", "data"]
    references = cut_up.where(F.col("kind") == _REFERENCE).drop("data").join(encoded, ["a", "b"]).select(*columns[:-1], F.col("chunk").alias("data"))
    parts = references.union(cut_up.where(F.col("kind") == _IDS).select(*columns)).repartition("uid").sortWithinPartitions("uid", "seq")
    final = T.StructType([docs.schema["doc_id"], *FINISHED[output]])
    final_arrow = _arrow(final)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_, now, doc_id, held = codec(tokenizer), None, None, []
        for batch in batches:
            rows = []
            for uid, doc, _, head, tail, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if uid != now:
                    if now is not None:
                        rows.append((doc_id, *_finish(b"".join(held), codec_, output)))
                    now, doc_id, held = uid, doc, []
                size = codec_.dtype.itemsize
                held.append(data[head * size : len(data) - tail * size])
            yield _batch(rows, final_arrow)
        if now is not None:
            yield _batch([(doc_id, *_finish(b"".join(held), codec_, output))], final_arrow)

    return cut_up.where(F.col("kind") == _DONE).select(*final.names).union(parts.mapInArrow(assemble, final))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
