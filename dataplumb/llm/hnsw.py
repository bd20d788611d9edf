"""Near-duplicate embeddings with hierarchical navigable small-world graphs.

Equal vectors are one node with a count. Nodes are dealt to shards by a hash; each shard gets a graph of layers: a layer
holds a share of the nodes of the one below, is built from the top down, in batches that double, and links each node to
its nearest nodes in several directions. Every shard is queried with the nodes of every shard: pairs of shards are
the units of work, searched both ways. A search keeps a beam of the best nodes met; beams are widened until an audit
passes: they must find the nodes of probes, queries made to be just as near as a link asks, so that there is something to find
where links are rare, and of some queries all links that a full scan shows. A query with as many links as the first beam holds
looks at the whole shard. Candidates are verified by their cosine in
double precision and counted for both ends, some queries at a time, and a spanning forest of the links goes on to the components, so that
what a task holds and emits grows with its nodes only, whatever the number of links.

The number of shards is SHARDS, or what keeps a shard within SHARD_ROWS and SHARD_BYTES, which bounds a task's memory. Work grows as nodes
times shards.

Defined cases: a vector that is null, empty, zero or holds a null or a number that isn't finite is linked with nothing
and is its own component, as is a vector of another length than those it is compared with; a null vec_id is never
linked and its component is null. Rows of one vec_id count for themselves. Other columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import components, drop_stored, stored, with_group

#: Shards at least; nodes of a shard and bytes of its vectors at most, in the mean.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 1 << 16, 1 << 26
#: Links of a node (twice as many in the lowest layer), share of a layer that is in the next one, beams.
LINKS, LAYER_SHARE, BUILD_BEAM, BEAM, WIDEN, EXPAND = 12, 16, 48, 48, 4, 4
#: Queries and probes that an audit looks at, and the share that must have been found.
AUDIT, RECALL = 64, 0.99
QUERIES_AT_ONCE = 256
#: Queries that look at all nodes at once: their links are held together.
SCANNED_AT_ONCE = 64
LEAST = 0.95
#: Beams are in single precision: what comes so near to LEAST is verified.
SLACK = 1e-4


@dataclass
class Graph:
    """ids and counts of the nodes; vectors in double precision; unit vectors; layers from the lowest: links, -1 for none."""

    ids: np.ndarray
    counts: np.ndarray
    vectors: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)

    def pack(self) -> bytes:
        return pickle.dumps((self.ids, self.counts, self.vectors, self.layers))


def unpack(data: bytes) -> Graph:
    return Graph(*pickle.loads(data))  # noqa: S301  written by build() alone


def beam_search(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the width best nodes met among the first n, and their similarities; -1 where there are fewer.

    All queries go on together: each looks at the neighbours of its EXPAND best nodes not looked at yet.
    """
    q = len(queries)
    rows = np.arange(q)
    ids, sims = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32)
    done = np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, (queries * unit[entry]).sum(1), False
    seen[rows, entry] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        k = min(EXPAND, width)
        best = np.argpartition(-open_, k - 1, axis=1)[:, :k]
        there = np.take_along_axis(open_, best, 1) > -np.inf
        some = there.any(1)
        live, best, there = live[some], best[some], there[some]
        if not len(live):
            break
        done[live[:, None], best] = True
        nodes = np.where(there, ids[live[:, None], best], -1)
        near = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & (near < n) & ~seen[live[:, None], np.maximum(near, 0) % n]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", queries[live[r]], unit[near[r, c]])
        every = np.concatenate([sims[live], found], 1)
        keep = np.argpartition(-every, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), keep, 1)
        sims[live] = np.take_along_axis(every, keep, 1)
        ids[live] = np.where(sims[live] > -np.inf, ids[live], -1)
        done[live] |= ids[live] < 0
    return ids, sims


def spread(unit: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates up to most, nearest first, each nearer to the node than to any one taken before; then the rest."""
    sims = np.where(near >= 0, np.einsum("id,ijd->ij", unit[nodes], unit[near]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    between = np.einsum("ijd,ikd->ijk", unit[near], unit[near])
    taken = np.zeros(near.shape, bool)
    for k in range(near.shape[1]):
        clash = (taken[:, :k] & (between[:, k, :k] > sims[:, k, None])).any(1) if k else np.zeros(len(near), bool)
        taken[:, k] = ~clash & (near[:, k] >= 0) & (taken.sum(1) < most)
    # Places that are left go to the nearest of those passed over.
    rank = np.argsort(~taken + 2 * (near < 0), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, rank, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build_layer(unit: np.ndarray, most: int, entries) -> np.ndarray:
    """Links among the rows of unit. entries(rows): where the search for them begins."""
    n = len(unit)
    links = np.full((n, most), -1, np.int64)
    begin = 0
    while begin < n:
        end = min(n, max(64, 2 * begin, 1) if begin < 512 else begin + 512)
        new = np.arange(begin, end)
        own = unit[new] @ unit[new].T
        np.fill_diagonal(own, -np.inf)
        k = min(BUILD_BEAM // 2, len(new) - 1)
        near = new[np.argpartition(-own, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(new), 0), np.int64)
        if begin:
            met, _ = beam_search(unit, links, unit[new], np.minimum(entries(new), begin - 1), BUILD_BEAM, begin)
            near = np.concatenate([near, met], 1)
        links[new] = spread(unit, new, near, most)
        # Back links: each node that a new one chose looks at its own links and these again.
        source, target = np.repeat(new, most), links[new].ravel()
        good = target >= 0
        order = np.argsort(target[good], kind="stable")
        source, target = source[good][order], target[good][order]
        nodes, first, size = np.unique(target, return_index=True, return_counts=True)
        room = min(int(size.max(initial=0)), 2 * most)
        back = np.full((len(nodes), room), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(first, size)
        fits = place < room
        back[np.repeat(np.arange(len(nodes)), size)[fits], place[fits]] = source[fits]
        both = np.concatenate([links[nodes], back], 1)
        both = np.where((both[:, :, None] == both[:, None, :]).argmax(2) == np.arange(both.shape[1]), both, -1)
        for at in range(0, len(nodes), 512):
            links[nodes[at : at + 512]] = spread(unit, nodes[at : at + 512], both[at : at + 512], most)
        begin = end
    return links


def build(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> Graph:
    graph = Graph(ids, counts, vectors)
    n, sizes = len(ids), [len(ids)]
    while sizes[-1] > 4 * LAYER_SHARE:
        sizes.append(sizes[-1] // LAYER_SHARE)
    # Rows are in the order of a hash, so that the first ones of a layer are a fair sample of it.
    upper: list[np.ndarray] = []
    for level in range(len(sizes) - 1, -1, -1):
        m = sizes[level]
        upper.insert(0, build_layer(graph.unit[:m], 2 * LINKS if level == 0 else LINKS, lambda rows, above=list(upper): descend(graph.unit, above, graph.unit[rows])))
    graph.layers = upper
    assert len(upper[0]) == n
    return graph


def descend(unit: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Each query's nearest node, from the top layer down."""
    entry = np.zeros(len(queries), np.int64)
    for links in reversed(layers):
        ids, sims = beam_search(unit, links, queries, np.minimum(entry, len(links) - 1), 4, len(links))
        entry = ids[np.arange(len(queries)), sims.argmax(1)]
    return entry


def scan(graph: Graph, queries: np.ndarray) -> list[np.ndarray]:
    """All nodes near each query, by looking at every one."""
    return [np.flatnonzero(row) for row in (queries @ graph.unit.T >= LEAST - SLACK)]


def probes(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """AUDIT nodes, and for each a query whose cosine to it is just LEAST: what a beam must be able to find, links or not."""
    n = len(graph.ids)
    draw = np.random.default_rng(n)
    nodes = np.unique(draw.integers(0, n, AUDIT))
    base = graph.unit[nodes].astype(np.float64)
    turn = draw.standard_normal(base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.maximum(np.sqrt((turn * turn).sum(1, keepdims=True)), 1e-12)
    return nodes, (LEAST * base + np.sqrt(1 - LEAST * LEAST) * turn).astype(np.float32)


def beams(graph: Graph, queries: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, ids, similarities) of the beams of some queries at a time."""
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[at : at + QUERIES_AT_ONCE]
        entry = descend(graph.unit, graph.layers[1:], part)
        yield at, *beam_search(graph.unit, graph.layers[0], part, entry, width, len(graph.ids))


def found_probes(graph: Graph, width: int) -> float:
    """The share of the probes whose node their beam finds. A dimension of one has no directions to turn to."""
    if graph.unit.shape[1] < 2:
        return 0.0
    nodes, queries = probes(graph)
    return sum(int((ids == nodes[at : at + len(ids), None]).any(1).sum()) for at, ids, _ in beams(graph, queries, width)) / len(nodes)


def audited_width(graph: Graph, queries: np.ndarray, own: bool) -> int | None:
    """The width of beams that finds RECALL of the probes and of the true links (but those of a node with itself) of AUDIT queries; None: none does, and
    nodes are looked at one by one. Queries whose beam is full of links don't count, as they look at all nodes anyway."""
    n, width = len(graph.ids), BEAM
    picked = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)) if len(queries) else np.zeros(0, int)
    truth = dict(zip(picked.tolist(), scan(graph, queries[picked]), strict=True))
    if own:
        truth = {k: x[x != k] for k, x in truth.items()}
    while 4 * width < n:
        if found_probes(graph, width) >= RECALL:
            still, met, want = [], 0, 0
            for at, ids, sims in beams(graph, queries[picked], width):
                for k, i, good in zip(picked[at : at + len(ids)].tolist(), ids, sims >= LEAST - SLACK, strict=True):
                    if not good.all():
                        still.append(k)
                        met += len(np.intersect1d(i[good], truth[k]))
                        want += len(truth[k])
            if met >= RECALL * want:
                return width
            picked = np.array(still, int)
        width *= WIDEN
    return None


def near_blocks(graph: Graph, queries: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """(queries, the nodes found near each, whether these are all) for some queries at a time. own: the queries are the graph's nodes, in order.

    A query with BEAM links or more looks at all nodes, so that what others found is bounded.
    """
    width = audited_width(graph, queries, own)

    def whole(rows: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
        for at in range(0, len(rows), SCANNED_AT_ONCE):
            part = rows[at : at + SCANNED_AT_ONCE]
            yield part, scan(graph, queries[part]), True

    if width is None:
        yield from whole(np.arange(len(queries)))
        return
    for at, ids, sims in beams(graph, queries, width):
        good = sims >= LEAST - SLACK
        many = good.sum(1) >= BEAM
        few = np.flatnonzero(~many)
        yield at + few, [ids[k][good[k]] for k in few], False
        yield from whole(at + np.flatnonzero(many))


def near(graph: Graph, queries: np.ndarray, own: bool = False) -> list[np.ndarray]:
    """The nodes found near each query."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    for rows, found, _ in near_blocks(graph, queries, own):
        for k, x in zip(rows.tolist(), found, strict=True):
            out[k] = x
    return out


def link_blocks(left: Graph, right: Graph, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (row of left, row of right), each once, some at a time: what is held doesn't grow with the pairs.

    A query that looked at all nodes has all of its links, which are counted at once; the few that other queries found are
    held, and those between two of these are counted at the end, whichever of the two found them.
    """
    if left.vectors.shape[1] != right.vectors.shape[1]:
        return

    def flat(rows: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found])

    def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            cosine = np.einsum("ij,ij->i", left.vectors[x], right.vectors[y]) / (left.norms[x] * right.norms[y])
            keep[at : at + (1 << 16)] = cosine >= LEAST
        return a[keep], b[keep]

    held = []
    all_left = np.zeros(len(left.ids), bool)
    for rows, found, whole in near_blocks(right, left.unit, own=same):
        a, b = flat(rows, found)
        if not whole:
            held.append((a, b))
            continue
        if same:
            # Of two queries that both look at all nodes, the later one leaves the pair out, and within a block the higher one.
            here = np.zeros(len(left.ids), bool)
            here[rows] = True
            keep = np.where(here[b], a < b, ~all_left[b])
            a, b = a[keep], b[keep]
        all_left[rows] = True
        yield verified(a, b)
    all_right = all_left if same else np.zeros(len(right.ids), bool)
    for rows, found, whole in near_blocks(left, right.unit) if not same else ():
        b, a = flat(rows, found)
        if not whole:
            held.append((a, b))
            continue
        all_right[rows] = True
        keep = ~all_left[a]
        yield verified(a[keep], b[keep])
    a, b = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in range(2))
    if same:
        a, b = np.minimum(a, b), np.maximum(a, b)
    keep = ~all_left[a] & ~all_right[b] & ((a != b) | (not same))
    code = np.unique(a[keep] * len(right.ids) + b[keep])
    yield verified(code // len(right.ids), code % len(right.ids))


def linked(left: Graph, right: Graph, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All verified pairs (row of left, row of right), each once."""
    blocks = list(link_blocks(left, right, same))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in blocks)]) for k in range(2))


class Tally:
    """Links counted for both ends, by the copies of the other end, and a forest of them."""

    def __init__(self, left: Graph, right: Graph, same: bool):
        self.left, self.right, self.shift = left, right, 0 if same else len(left.ids)
        self.sums = np.zeros(len(left.ids) + (0 if same else len(right.ids)), np.int64)
        self.parent, self.tree = np.arange(len(self.sums)), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows of left and right."""
        np.add.at(self.sums, a, self.right.counts[b])
        b = b + self.shift
        np.add.at(self.sums, b, self.left.counts[a])
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        # Of the pairs between two trees one for each two.
        x, y = self.parent[a], self.parent[b]
        _, first = np.unique(np.minimum(x, y) * len(self.parent) + np.maximum(x, y), return_index=True)
        first = first[x[first] != y[first]]
        self.tree += _forest(a[first], b[first], self.parent)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, k1 and k2 (the digest of the vector, null: none to compare) and the vector's bytes in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys1, keys2, data = [], [], []
            for x in batch.column(1):
                raw = None
                if x.is_valid and x.values.null_count == 0 and len(x.values):
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    scale = np.abs(v).max()
                    if np.isfinite(v).all() and scale > 0:
                        raw = (v if 1e-100 < scale < 1e100 else v / scale).astype("<f8") + 0.0
                        raw = raw.tobytes()
                digest = xxhash.xxh3_128_digest(raw) if raw else None
                keys1.append(int.from_bytes(digest[:8], "little", signed=True) if raw else None)
                keys2.append(int.from_bytes(digest[8:], "little", signed=True) if raw else None)
                data.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(data, pa.binary())], names=["vec_id", "k1", "k2", "data"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, k1 long, k2 long, data binary")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors(vec_id, embedding)."""
    if not isinstance(vectors.schema["vec_id"].dataType, T.IntegralType):
        raise TypeError("vec_id must be a whole number")
    rows = stored(nodes_of(vectors), "vectors")
    good = rows.where("k1 is not null and vec_id is not null")
    nodes = stored(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("data").alias("data")), "nodes")
    lengths = F.octet_length("data")
    size = nodes.agg(F.count("*").alias("rows"), F.coalesce(F.sum(lengths), F.lit(0)).alias("bytes")).first()
    shards = max(SHARDS, -(-size["rows"] // SHARD_ROWS), -(-size["bytes"] // SHARD_BYTES))
    # A shard holds vectors of one length, in the order of a hash.
    dealt = nodes.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), lengths.alias("length"), "k1", "rep", "n", "data")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "length", "k1")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def graph() -> pa.RecordBatch:
            ids, counts, data = (list(x) for x in zip(*held, strict=True))
            made = build(np.array(ids, np.int64), np.array(counts, np.int64), np.frombuffer(b"".join(data), "<f8").reshape(len(ids), -1))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([made.pack()], pa.binary())], names=["shard", "length", "graph"])

        for batch in batches:
            for shard, length, _, rep, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, length) != key:
                    if held:
                        yield graph()
                    key, held = (shard, length), []
                held.append((rep, n, data))
        if held:
            yield graph()

    graphs = stored(dealt.mapInArrow(make, "shard int, length int, graph binary"), "graphs")
    left = graphs.select(F.col("shard").alias("i"), "length", F.col("graph").alias("left"), F.explode(F.sequence("shard", F.lit(shards - 1))).alias("j"))
    right = graphs.select(F.col("shard").alias("j"), "length", F.col("graph").alias("right"))
    pairs = left.join(right.hint("merge"), ["j", "length"])
    # One pair in a task.
    number = (F.col("i") * (2 * shards - F.col("i") + 1) / 2).cast("int") + F.col("j") - F.col("i")
    pairs = pairs.repartitionById(shards * (shards + 1) // 2, number)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(k) for k in ("i", "j", "left", "right")), strict=True):
                same = i.as_py() == j.as_py()
                a = unpack(x.as_py())
                b = a if same else unpack(y.as_py())
                tally = Tally(a, b, same)
                for p, q in link_blocks(a, b, same):
                    tally.add(p, q)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                tree = np.array(tally.tree, np.int64).reshape(-1, 2)
                some = tally.sums > 0
                nodes, counts = ids[some], tally.sums[some]
                left_, right_ = ids[tree[:, 0]], ids[tree[:, 1]]
                none = pa.nulls(len(left_), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, left_])), pa.chunked_array([pa.array(counts), none]).combine_chunks(), pa.chunked_array([pa.nulls(len(nodes), pa.int64()), pa.array(right_)]).combine_chunks()], names=["a", "n", "b"])

    found = stored(pairs.select("i", "j", "left", "right").mapInArrow(search, "a long, n long, b long"), "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    parts = components(found.where("b is not null").select("a", "b"))
    known = nodes.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "rep", "n").join(counts, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = stored(known.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    drop_stored(graphs, found, nodes, parts)
    # A much repeated vector is one key: its row is looked up without a shuffle.
    out = with_group(rows.drop("data"), known, ("k1", "k2"))
    there = F.col("vec_id").isNotNull()
    component = F.when(there, F.coalesce("component", "vec_id"))
    links = F.when(there, F.col("links"))
    return out.select("vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs those that join two trees; parent follows."""
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = parent[parent[rx]]
            rx = parent[rx]
        while parent[ry] != ry:
            parent[ry] = parent[parent[ry]]
            ry = parent[ry]
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out
