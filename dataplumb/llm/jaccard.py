"""Jaccard self-join of documents on word n-grams, filtered under several global token orders.

Under any one order of all tokens, two sets of similarity t share a token among the first n - ceil(t n) + 1 of each (n: the
set's size). So a pair is a candidate only if it shares such a prefix token under each of ORDERS orders, and pairs found
under the single orders are intersected before any set is compared. The orders are hashes with different factors; tokens
that a sample of the documents shows to be frequent come last in all of them. Which tokens these are changes the work and
never the result: any order that is the same for all documents will do.

Pairs of one order count only where the place of their token leaves room for as many common tokens as their sizes ask. The first
order is taken by itself; only sets that met another one under it are posted under the others.

Equal sets are one node from the start, by digest. A posting list of more than LIST sets gives links to its first set
instead of pairs: under that order, sets that hang together by such links count as met. Pairs that met under all orders, one at
least by a short list, are candidates, and so are all sets that hang together by long lists under every order. What hangs together by
candidates is a family: every pair that can be similar lies in one. A family of more than BLOCK sets is first dealt into
cells of about BLOCK sets, TURNS times; what is in its largest component by then isn't compared again. The others are cut by size, so that similar
sets are in one class of sizes or in two side by side, and each class into blocks of about BLOCK sets; pairs of their blocks, and of these with blocks
of the largest component, are groups of their own, whose sets are compared
exactly by matrix products over the tokens that they share. Each group emits at most a spanning forest of its links,
so that nothing grows with the square of a class but the comparisons of sets outside of the largest component.

Defined cases: a document without words has an empty set and links with nothing; one with fewer words than a shingle has
its whole sequence as its one shingle. Rows of one doc_id are one node; a null doc_id is never linked and its component is null.
Very long texts are whole. doc_id must be of a whole number type; a TypeError says so before anything runs. Other columns are left out (unique() passes all through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import components, drop_stored, fresh, release, small, stored, tidy

ORDERS, LIST, BLOCK = 3, 64, 128
#: So often a large family is dealt into cells before the rest is compared.
TURNS = 2
#: One document in so many is looked at for frequent tokens; so often there is frequent; so many tokens at most.
SAMPLE_ONE_IN, FREQUENT, MOST_FREQUENT = 8, 3, 1 << 20
WORDS_KEPT = 300_000
#: Rows that are broadcast at once at most, of 8 or 16 bytes.
NAMED = 1_000_000

_U = np.uint64
_PLACE = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_ORDER = [_U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]


def mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x ^ x >> _U(33)) * factor
    x = (x ^ x >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(32)


class Words:
    """Hashes of words, with those of the first met remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and the white space of ASCII
        get = self.known.get
        found = [get(w) for w in words]
        if None in found:
            room = len(self.known) < WORDS_KEPT
            for k, h in enumerate(found):
                if h is None:
                    found[k] = h = xxhash.xxh3_64_intdigest(words[k])
                    if room:
                        self.known[words[k]] = h
        return np.array(found, _U)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The set's tokens in ascending order."""
    if not len(words):
        return words
    if len(words) < width:
        width = len(words)
    n = len(words) - width + 1
    total = np.full(n, width, _U)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(mixed(total, _PLACE[0]))


def _sets(batch: pa.RecordBatch, column: int, words: Words, width: int) -> Iterator[np.ndarray]:
    for text in batch.column(column).cast(pa.large_binary()):
        yield shingles(words.hashes(text.as_py() or b""), width)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, d1, d2 (the set's digest) and n (its size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sizes, digests = [], []
            for s in _sets(batch, 1, words, width):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sizes, pa.int64())], names=["doc_id", "d1", "d2", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long")


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Tokens that the sample shows to be frequent, the most frequent MOST_FREQUENT at most, in ascending order."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLE_ONE_IN)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, _U), *_sets(batch, 0, words, width)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(tokens), pa.array(counts.astype(np.int64))], names=["token", "c"])

    counted = some.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    with tidy(docs.sparkSession):
        found = counted.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(found.view(_U))


def prefixes(tokens: np.ndarray, late: np.ndarray, percent: int, orders: Sequence[int] = range(ORDERS)) -> Iterator[np.ndarray]:
    """For each of the orders the set's prefix, in that order; the two lowest bits tell the order."""
    n = len(tokens)
    length = n - (percent * n + 99) // 100 + 1
    if len(late):
        place = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
        is_late = late[place] == tokens
    else:
        is_late = np.zeros(n, bool)
    for k in orders:
        # The order's own bits are gone before the cut, so that keys are in one order for all sets.
        keys = mixed(tokens, _ORDER[k]) >> _U(1) & ~_U(3) | _U(k)
        keys[is_late] |= _U(1 << 63)
        if length < n:
            keys = np.partition(keys, length - 1)[:length]
        yield np.sort(keys)


_PAIR = "a long, b long, bits int"
#: Of a digest's first half, what names a node: the two lowest bits are free to tell an order.
NODE = ~3


def met(texts: DataFrame, width: int, percent: int, late, orders: Sequence[int]) -> DataFrame:
    """(a, b, bits) of nodes that meet under the orders: 1 << k in a short list of the order k, 8 << k for links of long lists to their first set."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            tokens, nodes, sizes, places, seen = [], [], [], [], set()
            for s in _sets(batch, 0, words, width):
                node = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) & NODE
                if len(s) and node not in seen:
                    seen.add(node)
                    found = np.concatenate(list(prefixes(s, late.value, percent, orders)))
                    tokens.append(found)
                    nodes.append(np.full(len(found), node))
                    sizes.append(np.full(len(found), len(s), np.int32))
                    places.append(np.tile(np.arange(1, len(found) // len(orders) + 1, dtype=np.int32), len(orders)))
            if tokens:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(tokens)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes, places))], names=["token", "node", "n", "place"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token; a list goes on from batch to batch."""
        held = (np.zeros(0, np.int64),) * 4
        first = None  # of a long list that is under way: (token, first set)
        for batch in batches:
            new = tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            rows = tuple(np.concatenate([h, x]) for h, x in zip(held, new, strict=True))
            # The last token's list may not be at its end yet; a long one gives its links now and leaves its first set.
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            out, first = _pairs(*(x[:last] for x in rows), percent, first)
            held = tuple(x[last:] for x in rows)
            if len(np.unique(held[1])) > LIST:
                if first is None or first[0] != held[0][0]:
                    first = (int(held[0][0]), int(held[1][0]))
                out = [*out, (np.full(len(held[0]), first[1]), held[1], 8 << (held[0] & 3))]
                held = tuple(x[:0] for x in held)
            yield _pair_batch(out)
        out, _ = _pairs(*held, percent, first)
        yield _pair_batch(out)

    posts = texts.select("text").mapInArrow(post, "token long, node long, n int, place int").repartition("token").sortWithinPartitions("token", "node")
    return posts.mapInArrow(pair, _PAIR).groupBy("a", "b").agg(F.bit_or("bits").alias("bits"))


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs joined with ids(rep, ...), a stored table, by doc_id: ids are broadcast, NAMED at once, so that no text is shuffled."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with tidy(docs.sparkSession):
        parts = max(1, math.ceil(ids.count() / NAMED))
    dealt = [ids.where(F.pmod(F.xxhash64("rep", F.lit("part")), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.union, [some.join(F.broadcast(x), F.col("doc_id") == F.col("rep")).drop("doc_id") for x in dealt])


def representatives(sets: DataFrame) -> DataFrame:
    """(d1, d2, rep, n): the smallest doc_id stands for each set."""
    return sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))


def candidate_pairs(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of nodes, a stored table: what hangs together by them holds all pairs that can be similar."""
    spark = docs.sparkSession
    late = spark.sparkContext.broadcast(frequent(docs, width))
    release(spark)
    first = stored(met(docs, width, percent, late, [0]), "first")
    release(spark)
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = representatives(sets).join(nodes, F.col("d1").bitwiseAND(NODE) == F.col("node"), "left_semi").select("rep").distinct()
    ids = stored(ids, "ids")
    later = stored(met(chosen(docs, ids), width, percent, late, range(1, ORDERS)), "later")
    drop_stored(ids)
    both = stored(first.union(later).groupBy("a", "b").agg(F.bit_or("bits").alias("bits")), "met")
    drop_stored(first, later)
    # What hangs together by long lists, for each order by itself.
    kinds = F.explode(F.filter(F.array(*(F.lit(k) for k in range(ORDERS))), lambda k: F.getbit(F.col("bits"), k + 3) == 1)).alias("k")
    long = both.where("bits >= 8").select("a", "b", kinds).select(*(F.col(x).bitwiseOR(F.col("k")).alias(x) for x in "ab"))
    parts = components(long)
    node = F.col("node").bitwiseAND(NODE)
    crowds = parts.groupBy(node.alias("node")).agg(*(F.max(F.when(F.col("node").bitwiseAND(3) == k, F.col("component"))).alias(f"c{k}") for k in range(ORDERS)))
    crowds = stored(crowds, "crowds")
    drop_stored(parts)
    pairs = both.where("bits & 7 > 0")
    crowd = small(crowds, NAMED // 4)
    for x in "ab":
        pairs = pairs.join(crowd.toDF(x, *(f"{x}{k}" for k in range(ORDERS))), x, "left")
    everywhere = reduce(Column.__and__, [(F.getbit("bits", F.lit(k)) == 1) | F.coalesce(F.col(f"a{k}") == F.col(f"b{k}"), F.lit(False)) for k in range(ORDERS)])
    pairs = pairs.where(everywhere).select("a", "b")
    keys = [f"c{k}" for k in range(ORDERS)]
    hot = crowds.dropna(subset=keys)
    hot = hot.join(hot.groupBy(*keys).agg(F.min("node").alias("a")), keys).select("a", F.col("node").alias("b")).where("a <> b")
    out = stored(pairs.union(hot), "candidates")
    drop_stored(both, crowds)
    return out


def _pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, first: tuple[int, int] | None) -> tuple[list, tuple[int, int] | None]:
    """Pairs of the short lists of whole tokens, links of the long ones, each with its bits."""
    if not len(token):
        return [], first
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n, place = token[keep], node[keep], n[keep], place[keep]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(begin, len(token)))
    out = []
    if first is not None and first[0] == token[0]:  # the rest of a long list
        out.append((np.full(size[0], first[1]), node[: size[0]], 8 << (token[: size[0]] & 3)))
        begin, size, first = begin[1:], size[1:], None
    long = size > LIST
    for b, s in zip(begin[long], size[long], strict=True):
        out.append((np.full(s - 1, node[b]), node[b + 1 : b + s], 8 << (token[b + 1 : b + s] & 3)))
    begin, size = begin[~long], size[~long]
    for gap in range(1, int(size.max(initial=1))):
        # Of each list the sets `gap` apart.
        some = size > gap
        left = np.repeat(begin[some], size[some] - gap) + _counting(size[some] - gap)
        a, b = n[left], n[left + gap]
        need = -(-percent * (a + b) // (percent + 100))  # common tokens; what is before the first one is lost to it
        good = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (place[left] <= a - need + 1) & (place[left + gap] <= b - need + 1)
        left = left[good]
        out.append((node[left], node[left + gap], 1 << (token[left] & 3)))
    return out, None if first is not None and first[0] != token[-1] else first


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _pair_batch(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, bits = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(3))
    rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), bits])[:, a != b], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["a", "b", "bits"])


def compare(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (row of left, row of right) of sets that are similar enough, by products of 0/1 matrices over shared tokens."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, _U), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, rows_a), (b, rows_b) = flat(left), flat(right)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)

    def places(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, tokens), max(len(shared) - 1, 0))
        there = shared[at] == tokens if len(shared) else np.zeros(len(tokens), bool)
        at, rows = at[there], rows[there]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    at_a, rows_a = places(a, rows_a)
    at_b, rows_b = places(b, rows_b)
    step = 4096
    for begin in range(0, len(shared), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((step, len(right)), np.float32)
        s, e = np.searchsorted(at_a, [begin, begin + step])
        x[rows_a[s:e], at_a[s:e] - begin] = 1
        s, e = np.searchsorted(at_b, [begin, begin + step])
        y[at_b[s:e] - begin, rows_b[s:e]] = 1
        common += x @ y
    n_a, n_b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = common.astype(np.int64)
    return np.argwhere((100 * both >= percent * (n_a[:, None] + n_b[None, :] - both)) & (both > 0))


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the pairs those that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): doc_ids of similar sets, enough of them to span the components of different sets; and tables to delete then."""
    spark = docs.sparkSession
    pairs = candidate_pairs(docs, sets, width, percent)
    release(spark)
    families = components(pairs)
    drop_stored(pairs)
    members = representatives(sets).join(families, F.col("d1").bitwiseAND(NODE) == F.col("node")).select("rep", "n", F.col("component").alias("family"))
    members = stored(members, "members")
    drop_stored(families)
    large = members.groupBy("family").agg(F.count("*").alias("all")).where(F.col("all") > BLOCK)
    large = stored(members.join(small(large), "family"), "large")
    few = stored(members.join(small(large.select("family").distinct()), "family", "left_anti").select("rep", "family"), "few")
    drop_stored(members)
    zero = F.lit(0)
    # A family that is one group comes as texts, which are smaller than sets.
    rows = chosen(docs, few).select("family", *_sides(zero, zero, zero, zero), *_own(zero, zero), "rep", F.col("text").cast("binary").alias("data"))
    found = stored(matched(rows, percent, width), "links")
    drop_stored(few)
    with tidy(spark):
        none = large.isEmpty()
    if none:
        return found, [found, large]
    wide, tables = large_links(docs, large, width, percent)
    return reduce(DataFrame.union, [found, *wide]), [found, large, *tables]


def large_links(docs: DataFrame, large: DataFrame, width: int, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of links (a, b) in families of more than BLOCK sets, given as large(rep, n, family, all); and tables to delete."""

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data = [s.tobytes() for s in _sets(batch, 0, words, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(data, pa.binary())], names=["rep", "data"])

    ids = stored(large.select("rep").distinct(), "ids")
    texts = chosen(docs, ids)
    data = stored(texts.select("text", "rep").mapInArrow(attach, "rep long, data binary"), "data")
    drop_stored(ids)
    found = []
    for turn in range(TURNS):
        cell = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("all") / BLOCK)).cast("int")
        cells = large.select("rep", "family", cell.alias("cell")).join(data, "rep")
        zero, cell = F.lit(0), F.col("cell")
        found.append(stored(matched(cells.select("family", *_sides(zero, cell, zero, cell), *_own(zero, cell), "rep", "data"), percent), "turn"))
    parts = components(reduce(DataFrame.union, found))
    part = F.coalesce("component", "rep")
    dealt = stored(large.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "n", "family", part.alias("part")), "dealt")
    drop_stored(parts)
    main = dealt.groupBy("family", "part").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts"))
    rows = dealt.join(small(main.where("parts > 1")), "family").withColumn("is_main", F.col("part") == F.col("main"))
    # Similar sizes differ by one class at most; a little more than the ratio keeps rounding out of it.
    rows = rows.withColumn("size", F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).cast("int"))
    counts = rows.groupBy("family", "size", "is_main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of = lambda kind: F.map_from_entries(F.filter(F.collect_list(F.when(kind, F.struct("size", "blocks"))), lambda x: x.isNotNull()))
    counts = counts.groupBy("family").agg(of(~F.col("is_main")).alias("others"), of(F.col("is_main")).alias("mains"))
    rows = rows.join(small(counts), "family")
    n_blocks = F.element_at(F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")), F.col("size"))
    # Blocks of the largest component count downwards from -1.
    block = F.pmod(F.xxhash64("rep"), n_blocks).cast("int")
    rows = rows.withColumn("block", F.when(F.col("is_main"), -1 - block).otherwise(block))
    size, block = F.col("size"), F.col("block")

    def with_blocks(counts: str, size: Column, make) -> Column:
        n = F.coalesce(F.try_element_at(counts, size), F.lit(0))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda t: F.struct(*make(t)))

    near = (size - 1, size, size + 1)
    of_main = F.concat(*(with_blocks("others", s, lambda t, s=s: _sides(s, t, size, block)) for s in near))
    of_other = F.concat(
        with_blocks("others", size, lambda t: _sides(size, F.least(block, t), size, F.greatest(block, t))),
        with_blocks("others", size + 1, lambda t: _sides(size, block, size + 1, t)),
        with_blocks("others", size - 1, lambda t: _sides(size - 1, t, size, block)),
        *(with_blocks("mains", s, lambda t, s=s: _sides(size, block, s, -1 - t)) for s in near),
    )
    groups = rows.select("family", "size", "block", "rep", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("group"))
    groups = groups.join(data, "rep").select("family", "group.*", "size", "block", "rep", "data")
    found.append(stored(matched(groups, percent), "rest"))
    drop_stored(dealt)
    return found, [*found, data]


def _sides(size1: Column, block1: Column, size2: Column, block2: Column) -> list[Column]:
    return [x.cast("int").alias(c) for x, c in ((size1, "size1"), (block1, "block1"), (size2, "size2"), (block2, "block2"))]


def _own(size: Column, block: Column) -> list[Column]:
    return [size.cast("int").alias("size"), block.cast("int").alias("block")]


def matched(rows: DataFrame, percent: int, width: int = 0) -> DataFrame:
    """(a, b): links of the groups (family, size1, block1, size2, block2) of rows(size, block, rep, data); with a width data are texts, else sets."""
    key = ["family", "size1", "block1", "size2", "block2"]
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.repartition(n_parts, *key).sortWithinPartitions(*key)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, words = None, [], Words()
        for batch in batches:
            out = []
            for *new, size, block, rep, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key:
                    out += _linked(key, rows, percent)
                    key, rows = new, []
                rows.append(([size, block], rep, shingles(words.hashes(data or b""), width) if width else np.frombuffer(data, _U)))
            yield _edges(out)
        yield _edges(_linked(key, rows, percent))

    return groups.mapInArrow(match, "a long, b long")


def _linked(key: list[int] | None, rows: list[tuple[list[int], int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of a group (family, size and block of the one side, size and block of the other)."""
    if key is None:
        return []
    left = [r for r in rows if r[0] == key[1:3]]
    right = left if key[1:3] == key[3:] else [r for r in rows if r[0] == key[3:]]
    pairs = compare([r[2] for r in left], [r[2] for r in right], percent)
    if left is right:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return [(left[a][1], left[b][1]) for a, b in forest(pairs, len(left))]
    return [(left[a][1], right[b - len(left)][1]) for a, b in forest(pairs + np.array([0, len(left)]), len(left) + len(right))]


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that similar documents lead to."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number")
    spark = docs.sparkSession
    sets = stored(described(docs, width), "sets")
    near, tables = links(docs, sets, width, percent)
    release(spark)
    parts = components(near)
    drop_stored(*tables)
    reps = representatives(sets)
    reps = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("d1").alias("r1"), F.col("d2").alias("r2"), F.coalesce("component", "rep").alias("component"))
    linked = (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")) & (F.col("n") > 0)
    out = sets.join(reps, linked, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def unique(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class: that whose doc_id is the component's. In docs' columns.

    Rows of one doc_id stay or go together; rows without one always stay.
    """
    (gone_id,) = fresh(docs, "gone")
    gone = classes(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
