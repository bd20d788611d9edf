"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what any match must contain. The index has
a posting list of documents for each trigram that a query asks for, by blocks of documents, so that no list outgrows
BLOCK_ROWS documents in the mean however common its trigram is. Queries intersect and unite posting lists; only
their documents meet the rule's expression. A rule without mandatory trigrams scans all documents.

All of it is DataFrame functions. Places are code points: a text is split at the matches, and lengths of pieces and
matches are added up.

Defined cases: a null text is an empty one. doc_ids may repeat or be null: the index then names the documents of that
id together, and each text is verified for itself. Rows keep their number; other columns are left out.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents in a block of the index, in the mean.
BLOCK_ROWS = 4096
#: Strings that a piece of an expression is spelled out to, at most.
SPELLED = 16


@dataclass(frozen=True)
class Rule:
    """group: the one whose length counts; shorter than least, a match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    query: object = field(default=None, compare=False)


# The base kinds.
ASSIGN = Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", r"[0-9a-f]+", 0, 24)
BASE = (ASSIGN, ACCESS, HEX)
#: Base kinds come first; among spans with one start the order of this list counts.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
)

#: Queries: True (every document), a trigram, ("and", queries), ("or", queries).
Query = bool | str | tuple


def _both(*queries: Query) -> Query:
    parts = {q for q in queries if q is not True}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _either(*queries: Query) -> Query:
    parts = set(queries)
    return True if True in parts or not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must contain that contains one of the strings."""
    return _either(*(_both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _sequence(items) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, True, True
    for item in items:
        more, needs = _item(*item)
        if more is not None and len(strings) * len(more) <= SPELLED:
            strings = {a + b for a in strings for b in more}
            continue
        query, whole = _both(query, _of_strings(strings), needs), False
        strings = more if more is not None else {""}
    return (strings, True) if whole else (None, _both(query, _of_strings(strings)))


def _item(op, value) -> tuple[set[str] | None, Query]:
    """The strings (in small letters) that it stands for, or None and what it needs."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, True
    if name == "IN":
        chars = {chr(v).lower() for o, v in value if str(o) == "LITERAL"}
        return (chars, True) if len(chars) <= 8 and all(str(o) == "LITERAL" for o, _ in value) else (None, True)
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "BRANCH":
        found = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in found) and len(strings := set().union(*(s for s, _ in found))) <= SPELLED:
            return strings, True
        return None, _either(*(_of_strings(s) if s is not None else q for s, q in found))
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, items = value
        strings, query = _sequence(items)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, True
        return None, True if not least else _of_strings(strings) if strings is not None else query
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> Query:
    """What the text, in small letters, of any match of the pattern contains."""
    strings, query = _sequence(regex_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1]))


def _documents_of(query: Query, postings: Column, none: Column) -> Column:
    """The documents of a query, from a block's map of posting lists."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), none)
    parts = [_documents_of(q, postings, none) for q in sorted(query[1], key=str)]
    out = parts[0]
    for part in parts[1:]:
        out = F.array_intersect(out, part) if query[0] == "and" else F.array_union(out, part)
    return out


def index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(block, trigram, ids): the doc_ids whose text has the trigram, a row for each block and trigram."""
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    text = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t)))[0]
    found = docs.where("text is not null").select("doc_id", F.explode(text).alias("trigram"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    return found.groupBy(block, "trigram").agg(F.collect_set(F.struct("doc_id")).alias("ids"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): numbers of the rules whose query the documents of that id satisfy."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    postings = index(docs, sorted(set().union(set(), *map(trigrams, queries.values()))))
    maps = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))
    none = F.array().cast(postings.schema["ids"].dataType)
    lists = F.array(*(F.struct(F.lit(k).alias("rule"), _documents_of(q, F.col("postings"), none).alias("ids")) for k, q in queries.items()))
    found = maps.select(F.explode(lists).alias("x")).select("x.rule", F.explode("x.ids").alias("id"))
    return found.groupBy("id.doc_id").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind_order, end, kind) of the leftmost matches that don't overlap, without those too short."""
    pattern = F.lit(rule.pattern)
    whole, counted = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("counts"))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["counts"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    # Most texts have no match: they cost one look at the expression.
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, array of (start, kind_order, end, kind) by start and then the order of the rules."""
    docs = docs.select("doc_id", "text")
    indexed = {k for k, r in enumerate(rules) if trigram_query(r.pattern) is not True}
    if indexed:
        named = candidates(docs, rules).withColumnRenamed("doc_id", "_id")
        docs = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<int>"))
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    found = [F.when(F.array_contains("rules", k), spans_of(text, r, k)).otherwise(none) if k in indexed else spans_of(text, r, k) for k, r in enumerate(rules)]
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(docs, rules)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
