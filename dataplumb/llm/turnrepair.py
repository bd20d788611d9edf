"""Cheapest repair of a conversation's turns, found by a rank-compressed dynamic program over segments.

A turn is kept (0), given the role of user or assistant (1) or deleted (2; blank and repeated turns must be); empty turns of
either can be inserted anywhere (5 each); a truncated turn that stays costs 5 more. The repaired roles follow one another as
`(s?(ua)+)?`. Of the cheapest edits those whose initials (D, I, K, R) are the least string win.

The program has a layer after each turn and four states in it: nothing yet, after the system turn, after a user's, after an assistant's.
What leads from layer to layer is a macro edit, a run of inserts with what is done to the turn: D, ID, IID, IIK, IIR,
IK, IR, K or R, in this order. (Runs of more than two are never cheapest: without two of them the roles still alternate.) No code is the beginning of another, so
of two strings of as many codes the first different code decides. A layer therefore keeps no strings but each state's cost, the rank of its string among the layer's, and a
pointer to the state before with the code; strings are read off the pointers afterwards. Layers are equal but for a constant again and again, so that steps are remembered.

Conversations of any length are cut into segments. A segment's table says for each state before and after it what the
way costs and which of the ways from one state is the lesser string; tables are followed like turns are. Steps:
(1) equal turns are counted together, first occurrences found, and rows dealt by ranges of (conversation, turn, role, text), so that a long
conversation lies in many tasks; (2) each task finishes the conversations that lie in it and in one segment, decides on the way through
longer ones, and for its first and last conversation, which may go on elsewhere, writes a table; (3) the driver
follows these, at most two a task; (4) segments are repaired, each for itself, and put together by conversation, as a stream.
Only the digest of a conversation, which by its nature goes over all of it in turn, is one task's work, without holding it.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered by role, then text; rows equal in all
are copies of one turn. A null conv_id is a conversation. An initial is the first character of a role, whatever it is. Conversations without rows have
no edits. Empty tables give empty tables. Other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop_stored, small, stored, tidy, with_group

CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The state after an inserted or retitled turn; states are 0 (nothing), 1 (system), 2 (user), 3 (assistant).
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: States that a conversation can end in after so many more inserts.
ENDS = ((0, 0), (3, 0), (2, 1), (0, 2), (1, 2))
#: A segment's turns and characters of text at most (one turn more).
TURNS, CHARACTERS = 4096, 1 << 20
LEGAL = {"su", "ua", "au"}
INITIALS = "sua"
SPACES = " \t\n\x0b\x0c\r"

#: Kinds of turns: 0 has to go; else 1 + 2 * place of the initial in INITIALS (3 for others) + 1 if truncated.
Ways = list[tuple[int, int] | None]
Table = list[Ways]


@functools.cache
def moves(kind: int) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, number of the code)."""
    out = []
    for before in range(4):
        state = before
        for run in range(3):
            prefix = "I" * run
            out.append((before, state, DELETE + INSERT * run, CODES.index(prefix + "D")))
            if kind:
                initial, cut = divmod(kind - 1, 2)
                more = INSERT * run + TRUNCATED * cut
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, initial))
                if kept is not None:
                    out.append((before, kept, more, CODES.index(prefix + "K")))
                out.append((before, NEXT[state], more + RETITLE, CODES.index(prefix + "R")))
            state = NEXT[state]
    return out


def _ranked(best: list[tuple | None]) -> list[int]:
    """Ranks of states by (rank before, code); best holds (cost, rank before, code, state before)."""
    order = sorted((b[1:3], q) for q, b in enumerate(best) if b)
    ranks = [0] * 4
    for r, (_, q) in enumerate(order):
        ranks[q] = r
    return ranks


@functools.cache
def step(layer: tuple[tuple[int, int] | None, ...], kind: int) -> tuple[tuple[tuple[int, int] | None, ...], int, tuple[tuple[int, int] | None, ...]]:
    """The next layer with the least cost taken off, that cost, and (state before, code) of each state.

    Differences of costs are small, as inserts lead from any state to another, so that few layers are ever met.
    """
    best: list[tuple | None] = [None] * 4
    for p, q, cost, code in moves(kind):
        if layer[p] is not None:
            found = (layer[p][0] + cost, layer[p][1], code, p)
            if best[q] is None or found < best[q]:
                best[q] = found
    ranks, least = _ranked(best), min(b[0] for b in best if b)
    return tuple(b and (b[0] - least, ranks[q]) for q, b in enumerate(best)), least, tuple(b and (b[3], b[2]) for b in best)


def at(state: int) -> tuple[tuple[int, int] | None, ...]:
    return tuple((0, 0) if q == state else None for q in range(4))


def table_of(kinds: bytes) -> Table:
    """By state before and after: cost, and rank among the ways from that state before."""
    out = []
    for entry in range(4):
        layer, total = at(entry), 0
        for kind in kinds:
            layer, cost, _ = step(layer, kind)
            total += cost
        out.append([w and (w[0] + total, w[1]) for w in layer])
    return out


def through(ways: Sequence[tuple[int, int] | None], table: Table) -> tuple[Ways, list[int | None]]:
    """The ways after a segment, and the state before it of each."""
    best: list[tuple | None] = [None] * 4
    for p, q in itertools.product(range(4), repeat=2):
        if ways[p] is not None and table[p][q] is not None:
            found = (ways[p][0] + table[p][q][0], ways[p][1], table[p][q][1], p)
            if best[q] is None or found < best[q]:
                best[q] = found
    ranks = _ranked(best)
    return [b and (b[0], ranks[q]) for q, b in enumerate(best)], [b and b[3] for b in best]


def together(a: Table, b: Table) -> Table:
    return [through(ways, b)[0] for ways in a]


def end_of(ways: Sequence[tuple[int, int] | None]) -> tuple[int, int, int]:
    """Cost of the whole, last state and inserts after it."""
    cost, _, more, state = min((ways[q][0] + INSERT * k, ways[q][1], k, q) for q, k in ENDS if ways[q] is not None)
    return cost, state, more


def route(tables: Sequence[Table], entry: int, last: int | None = None) -> tuple[list[int], int]:
    """States before, between and after segments on the best way (to the last state, or to the best end), and inserts after it."""
    ways, back = list(at(entry)), []
    for t in tables:
        ways, came = through(ways, t)
        back.append(came)
    more = 0
    if last is None:
        _, last, more = end_of(ways)
    states = [last]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1], more


def codes_of(kinds: bytes, entry: int, last: int) -> list[int]:
    layer, pointers = at(entry), []
    for kind in kinds:
        layer, _, back = step(layer, kind)
        pointers.append(back)
    out = []
    for back in reversed(pointers):
        last, code = back[last]
        out.append(code)
    return out[::-1]


def edited(kinds: bytes, roles: list[str], texts: list[str], entry: int, last: int, more: int) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) in order; deleted turns have neither. roles and texts: of turns that don't have to go."""
    state, turns = entry, iter(zip(roles, texts, strict=True))
    for kind, code in zip(kinds, codes_of(kinds, entry, last), strict=True):
        *inserts, edit = CODES[code]
        for _ in inserts:
            state = NEXT[state]
            yield "I", ROLES[state], ""
        role, text = next(turns) if kind else (None, None)
        if edit == "D":
            yield "D", None, None
        elif edit == "K":
            state = 1 if role.startswith("s") else 2 if role.startswith("u") else 3
            yield "K", role, text
        else:
            state = NEXT[state]
            yield "R", ROLES[state], text
    for _ in range(more):
        state = NEXT[state]
        yield "I", ROLES[state], ""


def pack_table(table: Table) -> bytes:
    return np.array([x for ways in table for w in ways for x in (w or (-1, 0))], "<i8").tobytes()


def unpack_table(data: bytes) -> Table:
    flat = np.frombuffer(data, "<i8").reshape(4, 4, 2).tolist()
    return [[None if c < 0 else (c, r) for c, r in ways] for ways in flat]


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults made by a checksum of `conv_id:turn`: present (else dropped), copies, and role and text as they are then."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_DONE, _SEGMENT, _WAY, _EDGE = range(4)
_STATS = ["blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns", "cost", "audit", "repaired"]


def _schema(conv: T.DataType) -> T.StructType:
    long, text, binary = T.LongType(), T.StringType(), T.BinaryType()
    kinds = [("kind", T.IntegerType()), ("conv_id", conv), ("part", T.IntegerType()), ("seg", long), ("blank", long), ("duplicate", long), ("truncated", long), ("illegal", long), ("first", text), ("last", text)]
    kinds += [("low", long), ("high", long), ("n_turns", long), ("cost", long), ("audit", text), ("repaired", binary)]
    kinds += [("kinds", binary), ("roles", T.ArrayType(text)), ("texts", T.ArrayType(text)), ("before", T.IntegerType()), ("after", T.IntegerType()), ("more", T.IntegerType()), ("ways", binary)]
    return T.StructType([T.StructField(n, t) for n, t in kinds])


class _Rows:
    """Output rows as batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, size: int = 0, **values) -> None:
        self.rows.append(values)
        self.size += size + 200

    def ready(self) -> Iterator[pa.RecordBatch]:
        if self.size > 1 << 23:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            rows, self.rows, self.size = self.rows, [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.schema], schema=self.schema)


class _Segment:
    """The turns of a conversation that are looked at together, with what is counted of them."""

    def __init__(self):
        self.kinds, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.low = self.high = None

    def full(self, most: int) -> bool:
        return len(self.kinds) >= most or self.size >= CHARACTERS

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if fault in (1, 2):
            self.kinds.append(0)
            return
        place = INITIALS.find(initial) if initial else -1
        self.kinds.append(1 + 2 * (place if place >= 0 else 3) + (fault == 3))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def counts(self) -> dict:
        return {n: getattr(self, n) for n in _STATS[:9]}

    def digest(self, entry: int, last: int, more: int) -> tuple[str, bytes | None]:
        return _digest(bytes(self.kinds), self.roles, self.texts, entry, last, more)


def _digest(kinds: bytes, roles: list[str], texts: list[str], entry: int, last: int, more: int) -> tuple[str, bytes | None]:
    """Initials of the edits, and the repaired turns as lines (None without any)."""
    made = list(edited(kinds, roles, texts, entry, last, more))
    lines = [f"{role}:{text}" for edit, role, text in made if edit != "D"]
    return "".join(e for e, _, _ in made), "\n".join(lines).encode() if lines else None


def _first_pass(schema: pa.Schema, most: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), _Rows(schema)
        conv, here, tables, begun, first, seg = None, _Segment(), [], False, True, 0

        def close() -> None:
            """The segment at hand goes out as a row of its own."""
            nonlocal here, seg
            table = table_of(bytes(here.kinds))
            tables.append(table)
            out.add(here.size, kind=_SEGMENT, conv_id=conv, part=part, seg=seg, kinds=bytes(here.kinds), roles=here.roles, texts=here.texts, **here.counts())
            here, seg = _Segment(), seg + 1

        def finish(whole: bool) -> None:
            """The conversation is over in this task, and altogether if it is whole."""
            nonlocal here, tables
            if whole and digest and not tables:
                layer, cost = at(0), 0
                for kind in here.kinds:
                    layer, c, _ = step(layer, kind)
                    cost += c
                total, last, more = end_of(layer)
                audit, lines = here.digest(0, last, more)
                out.add(len(audit), kind=_DONE, conv_id=conv, cost=cost + total, audit=audit, repaired=hashlib.sha256(lines or b"").digest(), **here.counts())
                here = _Segment()
                return
            close()
            if whole:
                states, more = route(tables, 0)
                for k, (a, b) in enumerate(itertools.pairwise(states)):
                    out.add(kind=_WAY, part=part, seg=seg - len(tables) + k, before=a, after=b, more=more if k == len(tables) - 1 else 0)
            else:
                out.add(300 * len(tables), kind=_EDGE, conv_id=conv, part=part, seg=seg - len(tables), repaired=pack_table(functools.reduce(together, tables)), ways=b"".join(map(pack_table, tables)))
            tables = []

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for conv_id, turn, role, text, n, fault in zip(*columns, strict=True):
                if not begun or conv_id != conv:
                    if begun:
                        finish(not first)
                        first = False
                    conv, begun = conv_id, True
                for k in range(n):
                    if here.full(most):
                        close()
                        yield from out.ready()
                    here.add(turn, role, text, fault if k == 0 or fault == 1 else 2)
                yield from out.ready()
        if begun:
            finish(False)
        yield from out.rest()

    return run


def _places(edges: pa.Table) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(state before, state after, inserts after it) of each task's part of a conversation that may lie in several."""
    rows = sorted(edges.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    out = {}
    for _, group in itertools.groupby(enumerate(rows), key=_runs(rows)):
        mine = [r for _, r in group]
        states, more = route([unpack_table(r["repaired"]) for r in mine], 0)
        for k, (r, a, b) in enumerate(zip(mine, states, states[1:], strict=False)):
            out[r["part"], r["seg"]] = (a, b, more if k == len(mine) - 1 else 0)
    return out


def _runs(rows: list[dict]):
    nth = list(itertools.accumulate((k > 0 and r["conv_id"] != rows[k - 1]["conv_id"] for k, r in enumerate(rows)), initial=0))[1:]
    return lambda pair: nth[pair[0]]


def _resolve(places, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in batches:
            for part, seg, ways in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                before, after, more = places.value[part, seg]
                tables = [unpack_table(ways[k : k + 256]) for k in range(0, len(ways), 256)]
                states, _ = route(tables, before, after)
                for k, (a, b) in enumerate(itertools.pairwise(states)):
                    out.add(part=part, seg=seg + k, before=a, after=b, more=more if k == len(tables) - 1 else 0)
            yield from out.rest()

    return run


def _cost(kinds: bytes, entry: int, last: int, more: int) -> int:
    return table_of(kinds)[entry][last][0] + INSERT * more


def _mend(schema: pa.Schema):
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                given = row["kinds"], row["roles"], row["texts"], row["before"], row["after"], row["more"]
                row["audit"], row["repaired"] = _digest(*given)
                row["cost"] = _cost(row["kinds"], row["before"], row["after"], row["more"])
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], f.type) for n, f in zip(names, schema, strict=True)], schema=schema)

    return run


def _join(schema: pa.Schema):
    """Segments of conversations in order to one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, audit, sha, lines = _Rows(schema), None, [], None, 0

        def done() -> None:
            out.add(sum(map(len, audit)), **{**now, "audit": "".join(audit), "repaired": sha.digest()})

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        done()
                    now, audit, sha, lines = {n: row[n] for n in ("conv_id", *_STATS)}, [], hashlib.sha256(), 0
                else:
                    for n in ("blank", "duplicate", "truncated", "illegal", "n_turns", "cost"):
                        now[n] += row[n]
                    if row["first"] is not None:
                        now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in LEGAL
                        now["last"] = row["last"]
                    if row["low"] is not None:
                        now["n_turns"] -= row["low"] == now["high"]
                        now["low"] = row["low"] if now["low"] is None else now["low"]
                        now["high"] = row["high"]
                audit.append(row["audit"])
                if row["repaired"] is not None:
                    sha.update((b"\n" if lines else b"") + row["repaired"])
                    lines += 1
            yield from out.ready()
        if now is not None:
            done()
        yield from out.rest()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def examined(turns: DataFrame, present: Column | None = None, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows) and fault (0, 1 blank, 2 repeated, 3 truncated) of distinct turns; rows that aren't
    present only name their conversation, with n = 0."""
    kind = turns.schema["conv_id"].dataType
    if isinstance(kind, (T.FractionalType, T.ArrayType, T.MapType, T.StructType)):
        raise TypeError("conv_id must be a whole number or a text")
    present, copies = F.lit(True) if present is None else F.coalesce(present, F.lit(False)), F.lit(1) if copies is None else copies
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.when(present, F.col("turn").cast("long")).alias("turn"), F.when(present, role).alias("role"), F.when(present, text).alias("text"), F.when(present, copies).otherwise(0).cast("long").alias("n"))
    rows = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")), "turns")
    bare = F.rtrim("text", F.lit(SPACES))
    key = F.md5(F.concat_ws(":", F.length("role"), "role", "text"))
    rows = rows.withColumn("key", key)
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    more = rows.where((F.col("n") > 0) & (bare != "")).groupBy("conv_id", "key").agg(F.min(place).alias("first_place"), F.count("*").alias("n")).where("n > 1")
    more = stored(more, "repeats")
    rows = with_group(rows.withColumn("place", place), more, ("conv_id", "key"))
    fault = F.when(bare == "", 1).when(F.col("first_place").isNotNull() & ~F.col("first_place").eqNullSafe(F.col("place")), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "n", F.coalesce(fault, F.lit(0)).alias("fault"))


def segmented(turns: DataFrame, present: Column | None, copies: Column | None, digest: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns in segments of at most so many with the states before and after each; and, if only digests are wanted, the
    conversations that were finished at once."""
    spark = turns.sparkSession
    rows = stored(examined(turns, present, copies), "examined")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    dealt = rows.repartitionByRange(parts, *first, F.left("text", F.lit(256)).asc_nulls_first()).sortWithinPartitions(*first, F.col("text").asc_nulls_first())
    schema = _schema(turns.schema["conv_id"].dataType)
    made = stored(dealt.mapInArrow(_first_pass(_arrow(schema), most, digest), schema), "segments")
    drop_stored(rows)
    edges = made.where(F.col("kind") == _EDGE)
    with tidy(spark):
        places = spark.sparkContext.broadcast(_places(edges.select("conv_id", "part", "seg", "repaired").toArrow()))
    way = T.StructType([schema[n] for n in ("part", "seg", "before", "after", "more")])
    ways = edges.select("part", "seg", "ways").mapInArrow(_resolve(places, _arrow(way)), way).union(made.where(F.col("kind") == _WAY).select(*way.names))
    segments = made.where(F.col("kind") == _SEGMENT).drop("before", "after", "more", "ways").join(small(stored(ways, "ways")), ["part", "seg"])
    return segments, made.where(F.col("kind") == _DONE)


def repair(turns: DataFrame, present: Column | None = None, copies: Column | None = None, most: int = TURNS) -> DataFrame:
    """The edits of every conversation, a row each: conv_id, edit, role and text (null where deleted), in the order of (part, seg, nth)."""
    segments, _ = segmented(turns, present, copies, False, most)
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("part", T.IntegerType()), *(T.StructField(n, t) for n, t in (("seg", long), ("nth", long), ("edit", text), ("role", text), ("text", text)))])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(arrow)
        for batch in batches:
            for row in batch.to_pylist():
                for k, (edit, role, text) in enumerate(edited(*(row[n] for n in ("kinds", "roles", "texts", "before", "after", "more")))):
                    out.add(len(text or ""), conv_id=row["conv_id"], part=row["part"], seg=row["seg"], nth=k, edit=edit, role=role, text=text)
                yield from out.ready()
        yield from out.rest()

    return segments.mapInArrow(run, schema)


def report(turns: DataFrame, present: Column | None = None, copies: Column | None = None, most: int = TURNS) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    segments, done = segmented(turns, present, copies, True, most)
    schema = _schema(turns.schema["conv_id"].dataType)
    piece = T.StructType([schema[n] for n in ("conv_id", "part", "seg", *_STATS)])
    whole = T.StructType([schema[n] for n in ("conv_id", *_STATS)])
    mended = segments.mapInArrow(_mend(_arrow(piece)), piece)
    ordered = mended.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    out = ordered.mapInArrow(_join(_arrow(whole)), whole).union(done.select(*whole.names))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lower(F.hex("repaired")).alias("repaired_sha256"))
