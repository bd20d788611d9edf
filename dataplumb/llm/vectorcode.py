"""Product codes of vectors: Lloyd's rounds in whole numbers, with Hamerly's bounds.

A vector's components become whole numbers (floor of scale times the component) and are cut into equal parts; each part
position has a codebook, and a part's code is the index of its nearest entry. Lloyd's rounds assign all parts and move
every entry to the mean of its parts.

Beside its code, a part keeps one upper bound of the distance to its entry and one lower bound of the distance to the
second nearest, in a table that goes from round to round. When entries move, the bounds move by as much; a part whose
upper bound is strictly below its lower bound, or below half the way from its entry to the next entry, keeps its code
unseen. Others first measure their own entry; where that fails too, all entries are scanned in whole numbers. Bounds are
rounded outwards and comparisons are strict, so that a tie always ends in a scan, which takes the lower index.

Each round is one pass over the table and writes the next one: vectors with codes and bounds, and from each task
the sums that its changed parts took from one entry to another. Only these differences are summed by Spark and go to the
driver, as one number for each entry and component. Sums and quotients are exact at any size.

Defined cases: rows whose vector is null or has null or non-finite components are left out. Vectors of another length than the most
frequent one that can be cut (of these the shortest) get null for code and error. With fewer vectors than entries the codebooks are shorter.
Null ids come last among the smallest; equal ids are ordered by vector. Whole numbers for which sums
of squares can exceed 2 ** 53 are computed one by one, without bounds; an error beyond a long is given as the largest long.
Other columns than the named ones are left out. Empty tables give empty tables and codebooks.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import quoted
from ._common import drop_stored, fresh, stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole numbers up to here are exact as doubles, in whatever order they are added.
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1
#: A code, an upper and a lower bound for each part.
_BYTES = 9

Books = list[list[tuple[int, ...]]]


@dataclass
class Codebooks:
    """By part and entry: whole components."""

    entries: Books
    scale: int

    def text(self) -> str:
        """All components in decimal with a comma between."""
        return ",".join(str(x) for part in self.entries for entry in part for x in entry)


def _up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that aren't smaller."""
    with np.errstate(over="ignore"):
        y = x.astype("<f4")
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that aren't larger."""
    return -_up(-x)


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared), np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared), -np.inf), 0)


def _way(a: Sequence[int], b: Sequence[int]) -> float:
    try:
        return math.dist(a, b)
    except OverflowError:
        return math.inf


class _Part:
    """One codebook, ready for comparisons, and how far its entries moved in the last round."""

    def __init__(self, entries: list[tuple[int, ...]], before: list[tuple[int, ...]] | None):
        self.exact = entries
        self.width = len(entries[0])
        # The largest whole number of a row for which all is exact in doubles.
        most = max((abs(x) for e in entries for x in e), default=0)
        self.limit = math.isqrt((EXACT - 1) // max(self.width, 1)) - most
        self.usable = self.limit >= 0
        if not self.usable:
            return
        self.c = np.array(entries, np.float64).reshape(len(entries), self.width)
        self.cc = (self.c**2).sum(1)
        between = self.cc[:, None] - 2 * self.c @ self.c.T + self.cc
        np.fill_diagonal(between, np.inf)
        self.half = np.nextafter(_root_down(between.min(1)) / 2, -np.inf)
        moved = [_way(a, b) for a, b in zip(entries, before or entries, strict=True)]
        moved = np.array([np.nextafter(m, np.inf, dtype=np.float64) if m else 0.0 for m in moved])
        most, at = moved.max(), int(moved.argmax())
        self.moved = moved
        self.others = np.full(len(moved), most)
        self.others[at] = np.delete(moved, at).max() if len(moved) > 1 else 0.0

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((x - self.c[code]) ** 2).sum(1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry, its distance and that of the second nearest, squared; ties go to the lower index."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.c.T + self.cc
        code, rows = d.argmin(1), np.arange(len(x))
        least = d[rows, code]
        d[rows, code] = np.inf
        return code, least, d.min(1)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The next code and bounds of each row, and how many rows were scanned."""
        upper = np.nextafter(upper.astype(np.float64) + self.moved[code], np.inf)
        lower = np.nextafter(lower.astype(np.float64) - self.others[code], -np.inf)
        bar = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < bar))
        upper[open_] = _root_up(self.own(x[open_], code[open_]))
        open_ = open_[~(upper[open_] < bar[open_])]
        if len(open_):
            code = code.copy()
            found, least, second = self.scan(x[open_])
            code[open_], upper[open_], lower[open_] = found, _root_up(least), _root_down(second)
        return code, upper, lower, len(open_)

    def plain(self, x: Sequence[int]) -> tuple[int, int]:
        """Nearest entry and squared distance of one part, in Python's whole numbers."""
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in self.exact]
        least = min(d)
        return d.index(least), least


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), as doubles where that is exact, which it is for a power of two; else infinite."""
    with np.errstate(over="ignore"):
        return np.floor(values.astype(np.float64) * scale)


def _exactly(values: np.ndarray, scale: int) -> list[int]:
    out = []
    for v in values.tolist():
        a, b = v.as_integer_ratio()
        out.append(a * scale // b)
    return out


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most 40 bits, so that sums of many fit in a long."""
    for k in itertools.count():
        if -(1 << 40) < value < 1 << 40:
            yield k, value
            return
        yield k, value & 0xFFFFFFFF
        value >>= 32


def _add_rows(total: np.ndarray, code: np.ndarray, x: np.ndarray, sign: int) -> None:
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    total[code[first], :-1] += sign * np.add.reduceat(x[order].astype(np.int64), first, axis=0)
    total[code[first], -1] += sign * np.diff(np.append(first, len(code)))


class _Assigner:
    """All parts of batches of vectors."""

    def __init__(self, books: Books, before: Books | None, scale: int):
        self.parts = [_Part(e, b) for e, b in zip(books, before or [None] * len(books), strict=True)]
        self.scale, self.width = scale, self.parts[0].width
        self.sums = np.zeros((len(books), len(books[0]), self.width + 1), np.int64)
        self.large: defaultdict[tuple[int, int, int], int] = defaultdict(int)

    def batch(self, values: np.ndarray, state: np.ndarray | None, sums: bool) -> tuple[np.ndarray, list[int]]:
        """values: rows of components; state: rows of bytes. The next state, and errors."""
        n, parts = len(values), len(self.parts)
        if state is None:
            code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.full((n, parts), -np.inf)
        else:
            code = state[:, :parts].astype(np.int64)
            bounds = np.ascontiguousarray(state[:, parts:]).view("<f4").astype(np.float64)
            upper, lower = bounds[:, :parts], bounds[:, parts:]
        x = whole(values, self.scale) if self.scale & (self.scale - 1) == 0 else None
        error = np.zeros(n, np.int64)
        errors: dict[int, int] = {}
        ncode, nupper, nlower = code.copy(), np.full((n, parts), np.inf), np.full((n, parts), -np.inf)
        for p, part in enumerate(self.parts):
            cut = slice(p * self.width, (p + 1) * self.width)
            fits = np.zeros(n, bool) if x is None or not part.usable else (np.abs(x[:, cut]) <= part.limit).all(1)
            rows = np.flatnonzero(fits)
            if len(rows):
                px = x[rows, cut]
                ncode[rows, p], nupper[rows, p], nlower[rows, p], _ = part.assign(px, code[rows, p], upper[rows, p], lower[rows, p])
                error[rows] += part.own(px, ncode[rows, p]).astype(np.int64)
                if sums:
                    old = rows[ncode[rows, p] != code[rows, p]] if state is not None else rows
                    if len(old):
                        _add_rows(self.sums[p], ncode[old, p], x[old, cut], 1)
                        if state is not None:
                            _add_rows(self.sums[p], code[old, p], x[old, cut], -1)
            for r in np.flatnonzero(~fits).tolist():
                px = _exactly(values[r, cut], self.scale)
                c, least = part.plain(px)
                errors[r] = errors.get(r, 0) + least
                ncode[r, p] = c
                if sums and (state is None or c != code[r, p]):
                    for e, sign in [(c, 1)] + ([(int(code[r, p]), -1)] if state is not None else []):
                        for k, v in enumerate([*px, 1]):
                            self.large[p, e, k] += sign * v
        found = error.tolist()
        for r, e in errors.items():
            found[r] = min(found[r] + e, LONG_MAX)
        bounds = np.concatenate([_up(nupper), _down(nlower)], axis=1).astype("<f4")
        return np.concatenate([ncode.astype(np.uint8), bounds.view(np.uint8).reshape(n, 8 * parts)], axis=1), found

    def differences(self) -> list[tuple[int, int, int]]:
        """(place, limb, value) of all sums that aren't zero."""
        flat = self.sums.reshape(-1)
        out = {int(k): int(flat[k]) for k in np.flatnonzero(flat)}
        shape = self.sums.shape
        for (p, e, k), v in self.large.items():
            place = (p * shape[1] + e) * shape[2] + k
            out[place] = out.get(place, 0) + v
        return [(place, limb, v) for place, total in out.items() for limb, v in _limbs(total) if v]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _states(column: pa.Array, width: int) -> np.ndarray | None:
    if column.null_count:
        return None
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all of its components are finite numbers."""
    each = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & each, F.lit(False))


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ("label",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The id and the columns to keep of every vector, with its code (binary, a byte for each part) and error (long); and the codebooks.

    Runs its rounds when called: entries of a round come from the sums of the one before.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    kind = vectors.schema[vector].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector} must be an array of numbers")
    element = "float" if isinstance(kind.elementType, T.FloatType) else "double"
    kept_names = [id, *keep]
    base = vectors.where(finite(quoted(vector))).select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept_names)), F.col(quoted(vector)).cast(f"array<{element}>").alias("vector"))
    lengths = base.groupBy(F.size("vector").alias("n")).count().where(f"n > 0 AND n % {parts} = 0").orderBy(F.desc("count"), "n").limit(1)
    with tidy(vectors.sparkSession):
        found = lengths.collect()
    code_type, error_type = T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())
    final = T.StructType([*(T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(kept_names)), code_type, error_type])
    names = [*kept_names, "code", "error"]
    if not found:
        return base.select(*(f"k{i}" for i in range(len(kept_names))), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).toDF(*names), Codebooks([[] for _ in range(parts)], scale)
    dims = found[0]["n"]
    width = dims // parts
    here = base.where(F.size("vector") == dims)
    with tidy(vectors.sparkSession):
        first = here.orderBy(F.col("k0").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()
    seeds = [_exactly(row, scale) for row in _matrix(first.column(0).combine_chunks(), dims)]
    books: Books = [[tuple(s[p * width : (p + 1) * width]) for s in seeds] for p in range(parts)]
    totals = [0] * (parts * len(seeds) * (width + 1))
    before, table, n_keep = None, here.withColumn("state", F.lit(None).cast("binary")), len(kept_names)
    kept_fields = final.fields[:n_keep]
    between = T.StructType([*kept_fields, T.StructField("vector", T.ArrayType(T.FloatType() if element == "float" else T.DoubleType())), T.StructField("state", T.BinaryType()), T.StructField("place", T.IntegerType()), T.StructField("limb", T.IntegerType()), T.StructField("value", T.LongType())])

    def assign(books: Books, before: Books | None, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = _Assigner(books, before, scale)
            kinds = None
            for batch in batches:
                kinds = batch.schema
                if not len(batch):
                    continue
                given = batch.columns[:n_keep]
                column = batch.column(n_keep)
                state, errors = work.batch(_matrix(column, dims), _states(batch.column(n_keep + 1), parts * _BYTES), not last)
                if last:
                    codes = np.ascontiguousarray(state[:, :parts]).tobytes()
                    code = pa.array([codes[a : a + parts] for a in range(0, len(codes), parts)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*given, code, pa.array(errors, pa.int64())], names=[f"k{i}" for i in range(n_keep)] + ["code", "error"])
                    continue
                data, size = state.tobytes(), parts * _BYTES
                packed = pa.array([data[a : a + size] for a in range(0, len(data), size)], pa.binary())
                none = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*given, column, packed, *none], names=between.names)
            if last or kinds is None:
                return
            moved = work.differences()
            if moved:
                blank = [pa.nulls(len(moved), f.type) for f in kinds][: n_keep + 2]
                yield pa.RecordBatch.from_arrays([*blank, *(pa.array([m[k] for m in moved], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64())))], names=between.names)

        return run

    for _ in range(rounds):
        done = stored(table.mapInArrow(assign(books, before, False), between), "codes")
        if before is not None:
            drop_stored(table)
        with tidy(vectors.sparkSession):
            moved = done.where(F.col("place").isNotNull()).groupBy("place", "limb").agg(F.sum("value").alias("value")).toArrow()
        for place, limb, value in zip(*(moved.column(c).to_pylist() for c in ("place", "limb", "value")), strict=True):
            totals[place] += value << 32 * limb
        before = books
        books = []
        for p in range(parts):
            made = []
            for e in range(len(seeds)):
                *sums, count = totals[(p * len(seeds) + e) * (width + 1) :][: width + 1]
                made.append(tuple(s // count for s in sums) if count else before[p][e])
            books.append(made)
        table = done.where(F.col("state").isNotNull()).select(*(f"k{i}" for i in range(n_keep)), "vector", "state")
        table._stored_path = done._stored_path
    coded = stored(table.mapInArrow(assign(books, before, True), final), "coded")
    if before is not None:
        drop_stored(table)
    odd = base.where(F.size("vector") != dims).select(*(f"k{i}" for i in range(n_keep)), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(odd).toDF(*names), Codebooks(books, scale)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", name: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for: the middle of its whole numbers' steps, by array lookup; null for a null code."""
    table = [F.array(*(F.array(*(F.lit((x + 0.5) / books.scale) for x in entry)) for entry in part)) for part in books.entries]
    byte = F.hex(F.col(quoted(code)))
    pieces = [F.element_at(t, F.conv(F.substring(byte, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, t in enumerate(table)]
    return codes.withColumn(name, F.when(F.col(quoted(code)).isNotNull(), F.concat(*pieces)))


def report(vectors: DataFrame, id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row for each coded vector: id, code in hex, error, label_error (over equal labels, nulls together), codebooks_sha256."""
    named = vectors.select(F.col(quoted(id)).alias("vec_id"), F.col(quoted(label)).alias("label"), F.col("embedding"))
    codes, books = compress(named)
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = with_sums(codes, sums, "label")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2(F.lit(books.text()), 256).alias("codebooks_sha256"))


def with_sums(rows: DataFrame, sums: DataFrame, key: str, most: int = 1024) -> DataFrame:
    """rows with the one row of sums (key, n and others) of their key, nulls equal.

    Keys of more than one row in `most` are at most `most` and are broadcast, so that no hot key meets a shuffle;
    all others are joined as Spark sees fit.
    """
    with tidy(rows.sparkSession):
        total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * most > total
    others = [c for c in sums.columns if c not in (key, "n")]
    k, made = fresh(rows, "k_", "hot_")
    both = sums.select(F.col(key).alias(k), F.struct(*others).alias(made), "n")
    first = rows.join(F.broadcast(both.where(hot).drop("n")), rows[key].eqNullSafe(F.col(k)), "left").drop(k)
    there = first.where(F.col(made).isNotNull())
    rest = first.where(F.col(made).isNull()).drop(made)
    rest = rest.join(both.where(~hot).drop("n"), rest[key].eqNullSafe(F.col(k)), "left").drop(k)
    return there.unionByName(rest).select(*rows.columns, *(F.col(made)[c].alias(c) for c in others))
