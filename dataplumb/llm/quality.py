"""Quality rules as a short-circuit cascade.

Each rule rejects documents by some statistic. On a bounded sample every rule's cost (seconds a document) and
selectivity (share rejected) are measured, and the rules are put in the order of rejection per cost, so that cheap
rules that reject much come first and a document that is rejected meets no later rule. The order changes the work,
never the verdict: a document is kept if no rule rejects it.

Defined cases: a null text is an empty one (no words, rejected by min_words); a null or repeated doc_id is no matter, as
rows are looked at one by one; very long texts are looked at alone. Other columns pass through unless they have the
names that the operator makes, which are replaced.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import SPACE, count_in, table_of, text_blocks

#: Rows that the costs and selectivities are measured on, at most.
SAMPLE_ROWS = 400
#: And characters of each.
SAMPLE_CHARS = 20_000

log = logging.getLogger(__name__)

SYMBOLS = table_of(b"#*$%&|<>")
UPPER, LOWER = table_of(range(65, 91)), table_of(range(97, 123))
LETTER = UPPER | LOWER | table_of(range(128, 256))
CONTINUED = table_of(range(128, 192))
EMPHASIS = table_of(b"!?")


class Texts:
    """Some texts and their statistics, each computed when first asked for. rows: the ones that are still of interest."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        self.known: dict = {}

    def of(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, name)()
        return self.known[name]

    def spaces(self) -> np.ndarray:
        return SPACE[self.data]

    def starts(self) -> np.ndarray:
        """Where words begin."""
        word = ~self.of("spaces")
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = self.at[:-1][self.at[:-1] < len(word)]
        begins[first] = word[first]
        return begins

    def n_words(self) -> np.ndarray:
        return count_in(self.of("starts"), self.at)

    def word_chars(self) -> np.ndarray:
        return count_in(~self.of("spaces") & ~CONTINUED[self.data], self.at)

    def n_symbols(self) -> np.ndarray:
        return count_in(SYMBOLS[self.data], self.at)

    def n_upper(self) -> np.ndarray:
        return count_in(UPPER[self.data], self.at)

    def n_lower(self) -> np.ndarray:
        return count_in(LOWER[self.data], self.at)

    def n_emphasis(self) -> np.ndarray:
        return count_in(EMPHASIS[self.data], self.at)

    def n_letter_words(self) -> np.ndarray:
        """Words with a letter."""
        starts = np.flatnonzero(self.of("starts"))
        if not len(starts):
            return np.zeros(self.n, np.int64)
        has = np.bitwise_or.reduceat(LETTER[self.data] & ~self.of("spaces"), starts)
        run = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(has, out=run[1:])
        place = np.searchsorted(starts, self.at)
        return run[place[1:]] - run[place[:-1]]

    def text(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()

    def lines(self, row: int) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier one."""
        lines = [x for x in self.text(row).split(b"\n") if x and not x.isspace()]
        return len(lines), len(lines) - len(set(lines))

    def repeated(self, row: int) -> int:
        """Words that stand in a window of three words found twice or more."""
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.text(row).split()], np.int64)
        n = len(ids)
        if n < 4:
            return 0
        base = len(number)
        if base < 2_000_000:
            windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:  # pairs are numbered first, so that no key overflows
            pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * base + ids[2:]
        order = np.argsort(windows, kind="stable")
        ran = windows[order]
        same = np.zeros(len(ran), bool)
        same[1:] = ran[1:] == ran[:-1]
        same[:-1] |= same[1:].copy()
        hit = np.zeros(n, bool)
        found = order[same]
        for k in range(3):
            hit[found + k] = True
        return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    """rejects(texts, rows) tells for each of the rows whether the rule rejects it."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


def _row(statistic: str, of: str, rows: np.ndarray, texts: Texts) -> np.ndarray:
    """A statistic that is counted text by text, remembered for each row."""
    kept = texts.known.setdefault(statistic, {})
    for r in rows:
        if r not in kept:
            kept[r] = getattr(texts, of)(int(r))
    return np.array([kept[r] for r in rows], np.int64)


MIN_WORDS, MOST_REPEATED = 50, 0.5


def _min_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    return t.of("n_words")[rows] < MIN_WORDS


def _repetition(t: Texts, rows: np.ndarray) -> np.ndarray:
    return 100 * _row("repeated", "repeated", rows, t) > 50 * t.of("n_words")[rows]


def _dup_lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    found = _row("lines", "lines", rows, t).reshape(-1, 2)
    return 2 * found[:, 1] > found[:, 0]


def _symbols(t: Texts, rows: np.ndarray) -> np.ndarray:
    return 10 * t.of("n_symbols")[rows] > t.of("n_words")[rows]


def _letters(t: Texts, rows: np.ndarray) -> np.ndarray:
    return 5 * t.of("n_letter_words")[rows] < 4 * t.of("n_words")[rows]


def _capitals(t: Texts, rows: np.ndarray) -> np.ndarray:
    upper, lower = t.of("n_upper")[rows], t.of("n_lower")[rows]
    return (upper + lower >= 20) & (upper > lower)


def _emphasis(t: Texts, rows: np.ndarray) -> np.ndarray:
    return 3 * t.of("n_emphasis")[rows] > t.of("n_words")[rows]


def _word_length(t: Texts, rows: np.ndarray) -> np.ndarray:
    chars, words = t.of("word_chars")[rows], t.of("n_words")[rows]
    return (chars < 2 * words) | (chars > 20 * words)


#: The first two are the base; the rest is the method's own.
BASE = (Rule("min_words", _min_words), Rule("repetition", _repetition))
RULES = (
    *BASE,
    Rule("duplicate_lines", _dup_lines),
    Rule("symbols", _symbols),
    Rule("letters", _letters),
    Rule("capitals", _capitals),
    Rule("emphasis", _emphasis),
    Rule("word_length", _word_length),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    selectivity: float


def measure(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Each rule's seconds a text and share rejected, on its own."""
    found = []
    for rule in rules:
        rejected, began = 0, time.perf_counter()
        for _, _, data, at in text_blocks(pa.array(texts, pa.string())):
            rejected += int(rule.rejects(block := Texts(data, at), np.arange(block.n)).sum())
        found.append(Measured(rule, max((time.perf_counter() - began) / max(1, len(texts)), 1e-9), rejected / max(1, len(texts))))
    return found


def ordered(measured: list[Measured]) -> tuple[Rule, ...]:
    """By rejection per cost, the largest first; rules that reject nothing by cost."""
    return tuple(m.rule for m in sorted(measured, key=lambda m: (-m.selectivity / m.cost, m.cost)))


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Whether each text is kept. A text that a rule rejects meets no later rule."""
    kept, rows = np.zeros(texts.n, bool), np.arange(texts.n)
    for rule in rules:
        if not len(rows):
            return kept
        rows = rows[~rule.rejects(texts, rows)]
    kept[rows] = True
    return kept


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, before: tuple[Rule, ...] = (), sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order measured on about sample_rows documents from all over the table, those that `before` rejects left out."""
    share = min(1.0, 1.2 * sample_rows / max(1, docs.count()))
    some = [r[0] for r in docs.select(F.substring("text", 1, SAMPLE_CHARS)).sample(share, seed=1).limit(sample_rows).collect()]
    kept = [t for t in some if cascade(next(Texts(d, at) for _, _, d, at in text_blocks(pa.array([t], pa.string()))), before)[0]]
    chosen = ordered(measure(kept or some, rules))
    log.info("quality rules in the order %s", [r.name for r in chosen])
    return chosen


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, in docs' columns."""
    chosen, at = plan(docs, rules), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cascade(Texts(data, offsets), chosen) for _, _, data, offsets in text_blocks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


STATISTICS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean"}


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id with the statistics of the base rules, base_failed and kept.

    All statistics are counted for every document; the other rules run as a cascade over those that the base keeps.
    """
    chosen = plan(docs, tuple(r for r in rules if r not in BASE), before=BASE)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, T.LongType() if v == "long" else T.BooleanType()) for k, v in STATISTICS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in text_blocks(batch.column(1)):
                texts, rows = Texts(data, at), np.arange(end - row)
                repeated, lines = _row("repeated", "repeated", rows, texts), _row("lines", "lines", rows, texts).reshape(-1, 2)
                failed = _min_words(texts, rows) | _repetition(texts, rows)
                made = [texts.of("n_words"), texts.of("word_chars"), texts.of("n_symbols"), lines[:, 1], repeated, failed, ~failed & cascade(texts, chosen)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *map(pa.array, made)], names=schema.names)

    return docs.mapInArrow(run, schema)
