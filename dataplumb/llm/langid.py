"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that are usual in it, and the filters lie bit-sliced: a slot of the table
holds one bit for each language, so that the slots of an n-gram, and-ed, give at once all languages that contain it. For
each text the bits are counted by language over all its n-grams, corrected by each filter's share of false positives
(its share of set bits to the power of the number of hashes), and the largest corrected share decides.

The filters are fitted on at most about TRAIN_DOCS labelled documents of each language, chosen by a hash of the id among those
whose crc32(doc_id as text) mod 3 is not 1. Prediction covers every whole text and looks at the text only.

n-grams are of bytes, with ASCII letters in small letters and runs of other ASCII characters as spaces; a space stands
before and after each text.

Defined cases: a null text or one without a letter gets "und" and 0; so does every text if no language could be learnt; if
no n-gram is known the most frequent language is taken, with 0; ties go to the more frequent language, then to the first
by name; a null id hashes as "". More than 64
languages take several words a slot. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import table_of, text_blocks
from ._common import pieces

#: Documents of each language that filters are fitted on, and characters of each, from all over it.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
SLOT_BITS, WORD_BITS = 20, 64
SIZES = (3, 5)
#: An n-gram belongs to a language if it stands there so often, and as this share of all n-grams of its size.
LEAST_COUNT, LEAST_SHARE = 3, 1e-5
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_LETTER = table_of([*range(65, 91), *range(97, 123)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with a space on both sides of each text; the text's number for each byte."""
    lens = np.diff(at)
    text = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 2)
    out = np.full(len(text), 32, np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(len(lens)), lens) + 1] = _FOLD[data]
    return out, text


def grams(folded: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams as numbers and the texts in which they stand; none is all spaces or has two spaces side by side."""
    n = len(folded) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value << np.uint64(8) | folded[k : k + n]
    space = folded == 32
    double = np.zeros(len(folded) + 1, np.int32)
    np.cumsum(space[1:] & space[:-1], out=double[1 : len(folded)])
    good = (text[:n] == text[size - 1 :]) & (double[size - 1 : size - 1 + n] == double[:n])
    return value[good] | np.uint64(size) << np.uint64(56), text[:n][good]


def slots(values: np.ndarray) -> Iterator[np.ndarray]:
    for factor in _FACTORS:
        mixed = (values ^ values >> np.uint64(29)) * factor
        yield ((mixed ^ mixed >> np.uint64(32)) * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


@dataclass
class Filters:
    """languages by frequency; tables: a bit for each language in each slot, 64 languages a table; chance: each filter's false positives."""

    languages: list[str]
    tables: list[np.ndarray]
    chance: np.ndarray


def fit(samples: dict[str, list[str]]) -> Filters:
    """Filters of the languages of samples, in that order."""
    languages = list(samples)
    tables = []
    for at in range(0, len(languages), WORD_BITS):
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages) - at, WORD_BITS) <= 8 * np.dtype(t).itemsize)
        tables.append(np.zeros(1 << SLOT_BITS, kind))
    for bit, language in enumerate(languages):
        table = tables[bit // WORD_BITS]
        found: dict[int, list[np.ndarray]] = {n: [] for n in SIZES}
        for _, _, data, at in text_blocks(pa.array(samples[language], pa.string())):
            folded, text = padded(data, at)
            for n in SIZES:
                found[n].append(grams(folded, text, n)[0])
        for n in SIZES:
            every = np.concatenate([np.zeros(0, np.uint64), *found[n]])
            values, counts = np.unique(every, return_counts=True)
            for place in slots(values[counts >= max(LEAST_COUNT, LEAST_SHARE * len(every))]):
                table[place] |= table.dtype.type(1 << bit % WORD_BITS)
    fill = np.array([np.count_nonzero(tables[bit // WORD_BITS] & tables[bit // WORD_BITS].dtype.type(1 << bit % WORD_BITS)) / (1 << SLOT_BITS) for bit in range(len(languages))])
    return Filters(languages, tables, fill ** len(_FACTORS))


def predict(data: np.ndarray, at: np.ndarray, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its language and the corrected share of its n-grams."""
    n_texts, n = len(at) - 1, len(filters.languages)
    folded, text = padded(data, at)
    hits, total = np.zeros((n_texts, n)), np.zeros(n_texts)
    for size in SIZES:
        values, where = grams(folded, text, size)
        first, second = slots(values)
        total += np.bincount(where, minlength=n_texts)
        for word, table in enumerate(filters.tables):
            mask = table[first] & table[second]
            for byte in range(mask.dtype.itemsize):
                part = (mask >> mask.dtype.type(8 * byte)).astype(np.uint8)
                counts = np.bincount(where.astype(np.int64) << 8 | part, minlength=n_texts << 8).reshape(n_texts, 256)
                low = WORD_BITS * word + 8 * byte
                for bit in range(low, min(n, low + 8)):
                    hits[:, bit] += counts[:, np.arange(256) >> (bit - low) & 1 == 1].sum(1)
    share = hits / np.maximum(total, 1)[:, None]
    corrected = np.clip((share - filters.chance) / np.maximum(1 - filters.chance, 1e-9), 0, 1)
    best = corrected.argmax(1)
    return best, corrected[np.arange(n_texts), best]


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Filters:
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(sorted(labelled.groupBy("lang").count().collect(), key=lambda r: (-r["count"], r["lang"])))
    # The share of each language's documents that brings `most` of them, by a hash of the id.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, most / n))) for k, n in counts.items()), F.lit(0.0))
    samples: dict[str, list[str]] = {k: [] for k in counts}
    if counts:
        for lang, text in labelled.where(draw < share).select("lang", pieces(F.col("text"), TRAIN_CHARS)).collect():
            samples[lang].append(text)
    return fit(samples)


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    filters = filters or train(docs)
    # The table goes out once, at most 8 bytes a slot.
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            for row, end, data, at in text_blocks(batch.column(2)):
                letters = np.add.reduceat(np.append(_LETTER[data], False), at[:-1]) > 0 if len(data) else np.zeros(end - row, bool)
                letters &= np.diff(at) > 0
                for k in np.flatnonzero(~letters & (np.diff(at) > 0)):
                    letters[k] = any(c.isalpha() for c in data[at[k] : at[k + 1]].tobytes().decode())
                if not filters.languages:
                    letters[:] = False
                best, score = predict(data, at, filters) if filters.languages else (np.zeros(end - row, int), np.zeros(end - row))
                names = [filters.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=schema.names)

    return docs.mapInArrow(run, schema)
