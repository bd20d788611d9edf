"""Repairs against all possible ones, and segments of a few turns against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from dataplumb.llm import turnrepair

SHAPE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(blank, duplicate, truncated, illegal, gaps) and the fault of each of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (out.count(1), out.count(2), out.count(3), illegal, gaps), out


def every(rows, found):
    """The cheapest of all edits with up to two inserts at each place, as (cost, audit, lines)."""
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        own = [("D", 2, None)]
        if fault not in (1, 2):
            more = 5 * (fault == 3)
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(own)
    inserts = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*choices):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            audit, lines = [], []
            for k, e in enumerate((*edits, None)):
                audit += ["I"] * len(places[k])
                lines += [(r, "") for r in places[k]]
                if e:
                    audit.append(e[0])
                    lines += [e[2]] if e[2] else []
            if SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                one = (cost, "".join(audit), [f"{r}:{t}" for r, t in lines])
                best = min(best, one) if best else one
    return best


def whole(rows, found):
    """The same by one program over the whole conversation."""
    kinds, roles, texts = bytearray(), [], []
    for (_, role, text), fault in zip(rows, found, strict=True):
        if fault in (1, 2):
            kinds.append(0)
            continue
        place = "sua".find(role[:1]) if role else -1
        kinds.append(1 + 2 * (place if place >= 0 else 3) + (fault == 3))
        roles.append(role)
        texts.append(text)
    cost, last, more = turnrepair.end_of(turnrepair.table_of(bytes(kinds))[0])
    made = list(turnrepair.edited(bytes(kinds), roles, texts, 0, last, more))
    return cost, "".join(e for e, _, _ in made), [f"{r}:{t}" for e, r, t in made if e != "D"]


def drawn(draw, n):
    roles = draw.choice([["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["user"], ["system", "assistant"]])
    texts = ["Yes.", "No", "", " \n", "Why?", "and so", "Go on!"]
    turn, out = draw.choice([None, 0, 5]), []
    for _ in range(n):
        out.append((turn, draw.choice(roles), draw.choice(texts)))
        if draw.random() < 0.8:
            turn = (turn or 0) + draw.choice([1, 1, 2])
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_cheapest_of_all():
    draw = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(40 if n < 3 else 12):
            rows = drawn(draw, n)
            _, found = faults(rows)
            assert whole(rows, found) == every(rows, found), rows


def test_ties_take_the_least_string():
    """A delete before an insert is the lesser string; DI and ID cost the same."""
    rows = [(0, "user", "Go."), (1, "user", ""), (2, "user", "On.")]
    _, found = faults(rows)
    cost, audit, _ = whole(rows, found)
    assert (cost, audit) == every(rows, found)[:2]
    assert cost == 3 and audit == "KDR"


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_segments(spark, most):
    """Every split gives what the whole conversation gives; conversations lie in several tasks."""
    draw = random.Random(2)
    conversations = {k: drawn(draw, draw.choice([0, 1, 2, 5, 9, 40])) for k in range(25)} | {None: drawn(draw, 300)}
    rows = [(c, *r, True, 1) for c, rs in conversations.items() for r in rs] + [(c, None, None, None, False, 1) for c in conversations]
    draw.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, copies int").repartition(3)
    got = {r.conv_id: r for r in turnrepair.report(turns, F.col("present"), F.col("copies"), most).collect()}
    assert set(got) == set(conversations)
    edits = {}
    for r in sorted(turnrepair.repair(turns, F.col("present"), F.col("copies"), most).collect(), key=lambda r: (r.part, r.seg, r.nth)):
        edits.setdefault(r.conv_id, []).append(r)
    for c, rs in conversations.items():
        counts, found = faults(rs)
        cost, audit, lines = whole(rs, found)
        r = got[c]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps) == counts
        assert (r.cost, r.audit) == (cost, audit), c
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        mine = edits.get(c, [])
        assert "".join(e.edit for e in mine) == audit and [f"{e.role}:{e.text}" for e in mine if e.edit != "D"] == lines


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 1, 2) for t in (None, *range(30))]
    got = turnrepair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        f = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        assert r.present == (f != 0) and r.copies == 1 + (f == 3)
        assert r.role == ("user" if f == 4 else "assistant")
        assert r.text == {1: "", 2: "One Two Three"}.get(f, "One. Two! Three?")
    assert len(got) == len(rows)


def test_odd_rows(spark):
    """Many copies of a turn, nulls, clashing names, no rows at all."""
    rows = [(1, 0, "user", "Hello.", 50), (1, 1, None, None, 2), (2, None, None, "x", 1), ("no", None, None, None, 0)]
    turns = spark.createDataFrame([(str(c), *r, "mine", "mine") for c, *r in rows], "conv_id string, turn int, role string, text string, copies int, fault string, n string")
    got = {r.conv_id: r for r in turnrepair.report(turns, F.col("copies") > 0, F.col("copies"), 7).collect()}
    assert got["1"].audit == "D" * 52 and got["1"].duplicate == 49 and got["1"].blank == 2 and got["1"].cost == 104
    assert (got["2"].audit, got["2"].truncated, got["2"].gaps) == ("D", 1, 0)
    assert (got["no"].audit, got["no"].cost, got["no"].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert turnrepair.report(turns.limit(0)).collect() == [] and turnrepair.repair(turns.limit(0)).collect() == []
    with pytest.raises(TypeError):
        turnrepair.report(turns.withColumn("conv_id", F.lit(1.5)))
