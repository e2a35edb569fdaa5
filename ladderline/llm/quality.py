"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both estimated on a sample: the rows of the SAMPLE_ROWS
smallest hashes of a doc_id, wherever they stand, of which those count that the base rule lets pass.
A rule's cost is the work that it does on the sample, counted as the bytes, words and lines that it
visits beyond what the base rule has visited, so it is the same in every run. The
rules run in descending order of rejection per cost. The texts that one rule rejects are taken out, and
the next is given the bytes and words of the others alone. The order changes the work, and which of several rules is named: a document is
kept if no rule rejects it.

Null and empty texts have no words and fail the base rule. Repeated rows get a row each; a null
doc_id stays null, and is in no sample. Rows that share an id are in the sample together. Other
columns of the input are ignored. An empty table gives no rows; without a sample the rules run as
given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import shared

#: Ids of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 512
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
_SAME = np.arange(256, dtype=np.uint8)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


#: Units of work of a byte, a word, a sorted word and a line that are visited (about a nanosecond each).
BYTE, WORD, SORTED, LINE = 1, 10, 40, 100


class Texts:
    """Some texts with what the rules ask for, computed at most once, only when asked, and counted in `work`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = K.Words(data, offsets)
        self.data, self.offsets, self.n, self.work = data, offsets, len(offsets) - 1, 0
        self.n_words = np.diff(self.words.ptr)

    def only(self, rows: np.ndarray) -> Texts:
        """These rows alone, ascending: their bytes are gathered, and what is known of their words and lines goes with them."""
        out = object.__new__(Texts)
        size, n_words = np.diff(self.offsets)[rows], self.n_words[rows]
        out.offsets = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(self.offsets[rows] - out.offsets[:-1], n_words)
        mask, kept = np.zeros(self.n, bool), np.zeros(len(self.words), bool)
        mask[rows] = True
        out.data = self.data[np.repeat(mask, np.diff(self.offsets))]
        kept = mask[self.words.row]
        words = object.__new__(K.Words)
        words.data, words.offsets = out.data, out.offsets
        words.inside = self.words.inside[np.repeat(mask, np.diff(self.offsets))]
        words.start, words.end = self.words.start[kept] - shift, self.words.end[kept] - shift
        words.ptr, words.row = np.concatenate([[0], np.cumsum(n_words)]), np.repeat(np.arange(len(rows)), n_words)
        out.words, out.n, out.n_words, out.work = words, len(rows), n_words, 0
        known = self.__dict__
        if "hashes" in known:
            out.hashes = self.hashes[kept]
        if "lines" in known:
            out.lines = (self.lines[0][rows], self.lines[1][rows])
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the table."""
        self.work += BYTE * len(self.data)
        return K.per_row(table[self.data], self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        self.work += BYTE * len(self.data) + WORD * len(self.words)
        return self.words.hashes(_SAME)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """How many lines with a word each text has, and how many of them repeat an earlier one."""
        total, dup = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for i in range(self.n):
            found = [x for x in self.text(i).split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            total[i], dup[i] = len(found), len(found) - len(set(found))
        self.work += BYTE * len(self.data) + LINE * int(total.sum())
        return total, dup

    @cached_property
    def base(self) -> dict[str, np.ndarray]:
        point = self.words.inside & ((self.data & 0xC0) != 0x80)
        rep = np.zeros(self.n, np.int64)
        hashes = K.windows(self.hashes, WINDOW)
        for i in np.flatnonzero(self.n_words > WINDOW):
            a, b = self.words.ptr[i], self.words.ptr[i + 1]
            _, back, count = np.unique(hashes[a : b - WINDOW + 1], return_inverse=True, return_counts=True)
            if len(count) < len(back):
                at, edges = np.flatnonzero(count[back] > 1), np.zeros(b - a + 1, np.int64)
                edges[at] += 1
                edges[at + WINDOW] -= 1
                rep[i] = np.count_nonzero(np.cumsum(edges))
        return {"word_chars": K.per_row(point, self.offsets), "n_symbols": self.count(SYMBOLS), "n_dup_lines": self.lines[1], "n_repeat_words": rep}

    @cached_property
    def failed(self) -> np.ndarray:
        """The base rule."""
        return (self.n_words < 20) | (100 * self.base["n_repeat_words"] > 30 * self.n_words)


def cascade(x: Texts, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(kept, the rule that rejected each text or None, units of work of the rules): every rule is given the texts alone that all before it let pass, and none runs on no text."""
    why, alive, work = np.full(x.n, None, object), np.flatnonzero(~x.failed), 0
    left = x.only(alive) if len(alive) < x.n else x
    left.work = 0
    for rule in rules:
        if not len(alive):
            break
        out = rule.value(left, np.arange(left.n)) > rule.limit
        if out.any():
            work += left.work
            why[alive[out]] = rule.name
            alive = alive[~out]
            left = left.only(np.flatnonzero(~out))
    kept = np.zeros(x.n, bool)
    kept[alive] = True
    return kept, why, work + left.work


def _table(values: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _LETTER, _LOUD = _table(range(65, 91)), _table([*range(65, 91), *range(97, 123)]), _table(b"!")
_WORDY = _LETTER | _table(range(128, 256))


def _no_letters(x: Texts, rows: np.ndarray) -> np.ndarray:
    """The share of words without a letter."""
    x.work += BYTE * len(x.data) + WORD * len(x.words)
    total = np.concatenate([[0], np.cumsum(_WORDY[x.data])])
    has = total[x.words.end] > total[x.words.start]
    return 1 - np.bincount(x.words.row[has], minlength=x.n)[rows] / np.maximum(1, x.n_words[rows])


def _top_word(x: Texts, rows: np.ndarray) -> np.ndarray:
    """The share of the most frequent word."""
    out = np.zeros(len(rows))
    h = x.hashes
    x.work += SORTED * len(h)
    for k, i in enumerate(rows):
        h = np.sort(x.hashes[x.words.ptr[i] : x.words.ptr[i + 1]])
        if len(h):
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            out[k] = np.diff(edges).max() / len(h)
    return out


def _word_length(x: Texts, rows: np.ndarray) -> np.ndarray:
    return x.count(~K.SPACE)[rows] / np.maximum(1, x.n_words[rows])


@dataclass(frozen=True)
class Rule:
    """Rejects the texts whose value is over the limit. Work that the texts don't count themselves can be stated by byte, word and line."""

    name: str
    value: Callable[[Texts, np.ndarray], np.ndarray]
    limit: float
    per_byte: float = 0.0
    per_word: float = 0.0
    per_line: float = 0.0


#: The production rules. Limits are wide: prose passes all of them.
RULES = (
    Rule("symbols", lambda x, rows: x.count(SYMBOLS)[rows] / np.maximum(1, x.n_words[rows]), 0.5),
    Rule("capitals", lambda x, rows: x.count(_UPPER)[rows] / np.maximum(1, x.count(_LETTER)[rows]), 0.6),
    Rule("exclamations", lambda x, rows: x.count(_LOUD)[rows] / np.maximum(1, x.n_words[rows]), 0.5),
    Rule("no_letters", _no_letters, 0.4),
    Rule("long_words", _word_length, 40),
    Rule("one_word", _top_word, 0.3),
    Rule("duplicate_lines", lambda x, rows: x.lines[1][rows] / np.maximum(1, x.lines[0][rows]), 0.5),
)


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, cost of a text, share rejected) on the sample, in the order in which the cascade runs; ties keep the given order. Sums alone leave the executors."""
    top = docs.filter("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    schema = "n long, bytes long, words long, lines long, " + ", ".join(f"bad{k} long, work{k} long" for k in range(len(rules)))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in K.slices(batch.column("text")):
                x = Texts(data, offsets)
                rows = np.flatnonzero(~x.failed)
                if len(rows):
                    sums = [len(rows), np.diff(offsets)[rows].sum(), x.n_words[rows].sum(), x.lines[0][rows].sum()]
                    for r in rules:  # each on texts that only the base rule has seen
                        own = x.only(rows)
                        sums += [np.count_nonzero(r.value(own, np.arange(own.n)) > r.limit), own.work]
                    yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in sums], names)

    if top is None:
        return [(r.name, 0.0, 0.0) for r in rules]
    sample = docs.filter(F.xxhash64(F.col("doc_id").cast("long")) <= top).select("text")
    got = sample.mapInArrow(shared.tidy(run), schema).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    n = max(1, got["n"])
    found = [(r.name, (got[f"work{k}"] + r.per_byte * got["bytes"] + r.per_word * got["words"] + r.per_line * got["lines"]) / n, got[f"bad{k}"] / n) for k, r in enumerate(rules)]
    return sorted(found, key=lambda f: -f[2] / max(f[1], 1e-9))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row per document of (doc_id, text): base counts, base verdict, the cascade's verdict and the rule that rejected it."""
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[name] for name, _, _ in estimates(docs, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                x = Texts(data, offsets)
                kept, why, _ = cascade(x, ordered)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, x.n), "n_words": x.n_words.astype(np.int64), **x.base, "base_failed": x.failed, "kept": kept, "rejected_by": pa.array(why, pa.string())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(shared.tidy(run), SCHEMA)
