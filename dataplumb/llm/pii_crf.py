"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. A token with a digit or an at sign is a node of the field with the labels of KINDS or
none. Its unary potential comes from a softmax model over its shape; neighbours in the text share learnt transition
potentials; and tokens that repeat each other or look alike (the same letters and digits, the same long digits, the same
name before an at sign) share a potential for the same label however far apart they stand, as edges from each occurrence to
the next. Tokens of base spans are observed, as none so are those of addresses and cards that fail their check. Loopy sum-product message passing, damped, over all documents of a
batch at once, gives each token's marginals; a token that the patterns left out becomes a span if a kind's marginal
reaches LEAST. So a number that is written in full once and cut short elsewhere is found in both places.

The model is fitted on about TRAIN_DOCS documents, TRAIN_CHARS characters of each from all over it, with the patterns' labels; AGREEMENT is
set, not learnt. Everything else covers all documents, whole.

Defined cases: a null text is an empty one; rows are looked at one by one, so repeated or null ids are no matter; other
columns are left out; without documents to fit on, nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pieces

#: The kinds in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS = 1000, 20_000
#: Log potential for one label on both sides of a skip edge, rounds of messages, damping, marginal of an added span.
AGREEMENT, ROUNDS, DAMPING, LEAST = 3.0, 12, 0.3, 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns of the contract; a match never begins inside a run of digits, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of name characters before an at sign, with the domain after it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(end, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether digits are a number up to 255, however many zeros come first."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str, refused: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start. refused gets the places that look like an address or a card and fail their check."""
    refused = [] if refused is None else refused
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_byte, m[0].split("."))):
                found.append((1, *m.span()))
            else:
                refused.append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
            elif 16 <= len(digits) <= 19:
                refused.append(m.span())
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


FEATURES = 27


def features(token: str, before: str) -> list[int]:
    """The shape features that a token has."""
    digits, letters = len(_DIGITS.findall(token)), sum(c.isalpha() for c in token)
    out = [0, 1 + min(digits, 5) // 2 if digits < 6 else 4 + min(digits - 6, 14) // 3, 10 + min(letters, 8) // 2]
    for k, has in enumerate(("@" in token, token.count(".") == 3, "." in token, "-" in token, token[:1] == "+", "(" in token, "=" in token or ":" in token, '"' in token or "'" in token, digits == len(token), before[-1:] == ":", before[:1] == "+", before[-1:] == ")"), 15):
        if has:
            out.append(k)
    return out


@dataclass
class Field:
    """Nodes and edges of some documents.

    spans: document, start, end and number of the token in the document. label: the observed one, -1 if none; skip:
    whether an edge is a skip edge.
    """

    spans: list[tuple[int, int, int, int]]
    label: np.ndarray
    shapes: list[list[int]]
    edges: np.ndarray
    skip: np.ndarray


def field_of(texts: list[str], bases: list[list[tuple[int, int, int]]], refused: list[list[tuple[int, int]]] | None = None) -> Field:
    spans, labels, shapes, edges, skip = [], [], [], [], []
    for doc, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if not _MARKED.search(text):
            continue
        covered = [(a, b, kind) for kind, a, b in base]
        if refused is not None:
            covered += [(a, b, len(KINDS)) for a, b in refused[doc]]
        covered.sort(key=lambda x: (x[0], x[2]))
        seen: dict[tuple[str, str], int] = {}
        before, last, place, c, reach = "", None, 0, 0, []
        for place, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            if not _MARKED.search(token):
                before = token
                continue
            a, b = m.span()
            while c < len(covered) and covered[c][0] < b:
                reach.append(covered[c])
                c += 1
            reach = [x for x in reach if x[1] > a]
            node = len(spans)
            # Without marks at its ends a token is the span that the field would add.
            core = token.strip("\"'.,;:!?()[]{}<>")
            shift = token.find(core) if core else 0
            spans.append((doc, a + shift, a + shift + len(core or token), place))
            labels.append(min(x[2] for x in reach) if reach else -1)
            shapes.append(features(token, before))
            if last is not None and place - last[1] <= 3:
                edges.append((last[0], node))
                skip.append(False)
            last, before = (node, place), token
            keys = {("same", re.sub(r"[^0-9a-z]", "", token.lower()))}
            digits = "".join(_DIGITS.findall(token))
            if len(digits) >= 7:
                keys.add(("digits", digits[-7:]))
            if "@" in token:
                keys.add(("name", token.lower().partition("@")[0].strip("\"'(<[")))
            for key in sorted(keys):
                if len(key[1]) >= 5:
                    if key in seen:
                        edges.append((seen[key], node))
                        skip.append(True)
                    seen[key] = node
    return Field(spans, np.array(labels, np.int64), shapes, np.array(edges, np.int64).reshape(-1, 2), np.array(skip, bool))


@dataclass
class Model:
    """unary: a weight for each shape feature and label (the last label: none); chain: log potentials of neighbours."""

    unary: np.ndarray
    chain: np.ndarray


def design(field: Field) -> np.ndarray:
    x = np.zeros((len(field.shapes), FEATURES))
    for k, on in enumerate(field.shapes):
        x[k, on] = 1
    return x


def fit(texts: list[str], steps: int = 150) -> Model:
    """Piecewise: the softmax model by gradient steps, transitions by smoothed counts."""
    field, n = field_of(texts, [base_spans(t) for t in texts]), len(KINDS) + 1
    y = np.where(field.label < 0, n - 1, field.label)
    weights, x = np.zeros((FEATURES, n)), design(field)
    if not len(y):
        weights[0, n - 1] = 8
        return Model(weights, np.zeros((n, n)))
    target = np.eye(n)[y]
    for _ in range(steps):
        score = x @ weights
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights += 2.0 * (x.T @ (target - p) / len(y) - 1e-4 * weights)
    near = field.edges[~field.skip]
    pairs = np.ones((n, n))
    np.add.at(pairs, (y[near[:, 0]], y[near[:, 1]]), 1)
    pairs /= pairs.sum()
    return Model(weights, 0.5 * np.log(pairs / (pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True))))


def marginals(field: Field, model: Model) -> np.ndarray:
    """By loopy message passing: of each node, for each label."""
    n, nodes, edges = len(KINDS) + 1, len(field.label), len(field.edges)
    score = design(field) @ model.unary
    unary = np.exp(score - score.max(1, keepdims=True))
    seen = field.label >= 0
    unary[seen] = 1e-6 + np.eye(n)[field.label[seen]]
    unary /= unary.sum(1, keepdims=True)
    same = np.eye(n) * AGREEMENT
    same[-1, -1] = 0
    potentials = np.exp(np.where(field.skip[:, None, None], same, model.chain))
    # Each edge sends a message both ways.
    source = np.concatenate([field.edges[:, 0], field.edges[:, 1]])
    to = np.concatenate([field.edges[:, 1], field.edges[:, 0]])
    potentials = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(edges, 2 * edges), np.arange(edges)])
    sent = np.full((2 * edges, n), 1 / n)
    for _ in range(ROUNDS if edges else 0):
        logs = np.log(sent)
        belief = np.log(unary)
        np.add.at(belief, to, logs)
        out = belief[source] - logs[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ea,eab->eb", out, potentials)
        new = new / new.sum(1, keepdims=True)
        sent = DAMPING * sent + (1 - DAMPING) * new
    belief = np.log(unary)
    if edges:
        np.add.at(belief, to, np.log(sent))
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return (belief / belief.sum(1, keepdims=True)).reshape(nodes, n)


def find(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, each (kind, start, end) by kind and start."""
    refused: list[list[tuple[int, int]]] = [[] for _ in texts]
    bases = [base_spans(t, r) for t, r in zip(texts, refused, strict=True)]
    field = field_of(texts, bases, refused)
    every = [list(b) for b in bases]
    if len(field.label):
        p, last = marginals(field, model)[:, :-1], (None, None, None)
        for node in np.flatnonzero((field.label < 0) & (p.max(1) >= LEAST)):
            doc, a, b, place = field.spans[node]
            kind = int(p[node].argmax())
            if last == (doc, kind, place - 1):  # tokens side by side are one span
                every[doc][-1] = (kind, every[doc][-1][1], b)
            else:
                every[doc].append((kind, a, b))
            last = doc, kind, place
    return [(b, sorted(e)) for b, e in zip(bases, every, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def train(docs: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Fitted on about `most` documents with a digit or an at sign, drawn by a hash, `chars` characters of each from all over it."""
    marked = docs.where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, most / max(1, marked.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("double") / (1 << 30)
    return fit(sorted(r[0] for r in marked.where(draw < share).select(pieces(F.col("text"), chars)).collect()))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    model = model or train(docs)
    docs = docs.select("doc_id", "text")
    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", long) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = find([t or "" for t in batch.column(1).to_pylist()], model)
                counts = np.array([np.bincount([s[0] for s in b], minlength=len(KINDS)) if b else np.zeros(len(KINDS), np.int64) for b, _ in found], np.int64)
                digests = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests), pa.array([written(e) for _, e in found])], names=schema.names)

    return docs.mapInArrow(run, schema)
