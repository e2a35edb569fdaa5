"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, hits near a second person, capitals,
punctuation and obfuscation. The learned lexicon holds the words that stand in toxic training rows
far more often than in others; a training row's own counts are taken out of its features.
Labels come from rows outside the held-out third (crc32 of the id, modulo 3, is 1) only, and from at
most TRAIN_ROWS of them, those with the smallest hash of their id; their features are gathered, and
the model is fitted in the driver. Labels, language, source and id are no inputs of a score.

Null and empty texts score as texts without words. Repeated rows get the same score each, and train as
one row (rows that share an id but not the text: the one with the smallest features); a null
doc_id is scored too, and is not held out. Other columns are ignored. An empty table gives no rows;
with no labels of both kinds to learn from, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from . import kernel as K
from . import shared

TRAIN_ROWS = 20_000
TOXIC = 0.7
#: A learned word stands in so many toxic training rows at least, with such a log odds ratio.
LEARNED_ROWS, LEARNED_ODDS = 4, 2.0
#: Insults, threats and profanity in four languages.
INSULTS = "idiot idiots moron morons stupid loser losers clown clowns scum trash garbage pathetic worthless disgusting dumb fool fools jerk ugly filth filthy vermin coward imbecile cretin creep scumbag lowlife idiote imbécile abruti connard salaud minable dégueulasse dummkopf arschloch abschaum widerlich erbärmlich wertlos schwachkopf imbécil estúpido estúpida basura asqueroso patético inútil escoria payaso".split()
THREATS = "kill hurt die hate destroy burn beat shoot strangle punch tuer haïr töten hassen matar odio".split()
PROFANITY = "damn crap shit fuck fucking bitch bastard ass asshole hell merde putain scheiße mierda puta joder".split()
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre du dich dir dein deine ihr euch usted tú ti".split()
NEAR = 5
NAMES = ["words", "insults", "insult_density", "insult_kinds", "threat_density", "profanity_density", "near_you", "you_density", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "hidden_hits", "stretched", "learned", "learned_density", "learned_odds", "learned_best"]

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEET = K.LOWER.copy()
for _a, _b in zip(b"0134578@$", b"oieastbas", strict=True):
    _LEET[_a] = _b
_LEET_KEEP = _LETTER.copy()
_LEET_KEEP[list(b"0134578@$")] = True


def _letters_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash of each span's kept bytes, seen through the table."""
    kept = keep[data]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=total[1:])
    return K.span_hash(K._BYTE[table[data[kept]]], total[start], total[end])


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([K.word_hash(w) for w in words], np.uint64))


_SETS = {"insults": _hashes(INSULTS), "threats": _hashes(THREATS), "profanity": _hashes(PROFANITY), "you": _hashes(YOU)}
_SPLIT_WORDS = _hashes([*INSULTS, *PROFANITY, *(w[:i] + w[i + 1 :] for w in [*INSULTS, *PROFANITY] if len(w) > 4 for i in range(1, len(w) - 1))])


class Lexicon:
    """Word hashes with how many toxic and other training rows have them."""

    def __init__(self, words: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int):
        order = np.argsort(words)
        self.words, self.toxic, self.other = words[order], toxic[order], other[order]
        self.n_toxic, self.n_other = n_toxic, n_other

    def add(self, out: np.ndarray, words: np.ndarray, row: np.ndarray, n: np.ndarray, y: np.ndarray | None) -> None:
        """Fills the last four features. y: the labels of training rows, whose own counts don't count."""
        if not len(self.words) or not len(words):
            return
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        there = self.words[at] == words
        at, row = at[there], row[there]
        a, b = self.toxic[at].astype(float), self.other[at].astype(float)
        if y is not None:
            a, b = a - y[row], b - (1 - y[row])
        odds = np.log((a + 0.5) / (self.n_toxic + 1)) - np.log((b + 0.5) / (self.n_other + 1))
        good = (a >= LEARNED_ROWS - 1) & (odds >= LEARNED_ODDS)
        at, row, odds = at[good], row[good], odds[good]
        out[:, -3] = np.bincount(row, minlength=len(out)) / n
        _, once = np.unique(row.astype(np.int64) * (len(self.words) + 1) + at, return_index=True)
        out[:, -4] = np.bincount(row[once], minlength=len(out))
        out[:, -2] = np.bincount(row[once], odds[once], minlength=len(out))
        np.maximum.at(out[:, -1], row, odds)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each distinct word of each text, letters only."""
    w = K.Words(data, offsets)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _letters_hash(data, w.start, w.end, _LETTER, K.LOWER)
    order = np.lexsort((h, w.row))
    h, row = h[order], w.row[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[first], row[first]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, y: np.ndarray | None = None) -> np.ndarray:
    """A row of NAMES for each text."""
    w = K.Words(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(NAMES)))
    n = np.maximum(1, np.diff(w.ptr))
    size = np.maximum(1, np.diff(offsets))
    if len(w):
        count = lambda flag: np.bincount(w.row[flag], minlength=rows)
        plain = _letters_hash(data, w.start, w.end, _LETTER, K.LOWER)
        leet = _letters_hash(data, w.start, w.end, _LEET_KEEP, _LEET)
        hit = {k: np.isin(plain, v) for k, v in _SETS.items()}
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        others = np.concatenate([[0], np.cumsum(~_ALNUM[data])])
        digits = np.concatenate([[0], np.cumsum(_ALNUM[data] & ~_LETTER[data])])
        has_letter = letters[w.end] > letters[w.start]
        # symbols or digits between a word's first and last letter
        at = np.flatnonzero(_LETTER[data])
        first = np.where(has_letter, at[np.minimum(np.searchsorted(at, w.start), max(0, len(at) - 1))] if len(at) else 0, w.start)
        last = np.where(has_letter, at[np.maximum(np.searchsorted(at, w.end) - 1, 0)] if len(at) else 0, w.start)
        mixed = has_letter & ((others[last] > others[first]) | (digits[last] > digits[first]))
        hidden = mixed & ~hit["insults"] & (np.isin(leet, _SETS["insults"]) | np.isin(plain, _SPLIT_WORDS))
        bad = hit["insults"] | hidden
        same = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            same[3:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        same = np.cumsum(same)
        stretched = same[w.end] > same[np.minimum(w.start + 2, len(data))]
        caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
        lower_or_upper = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        shouted = (lower_or_upper[w.end] - lower_or_upper[w.start] > 2) & (caps[w.end] - caps[w.start] == lower_or_upper[w.end] - lower_or_upper[w.start])
        you = np.flatnonzero(hit["you"])
        near = np.zeros(len(w), bool)
        if len(you):
            spot = np.flatnonzero(bad)
            k = np.searchsorted(you, spot)
            for nb in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
                near[spot] |= (np.abs(you[nb] - spot) <= NEAR) & (w.row[you[nb]] == w.row[spot])
        kinds = np.zeros(rows)
        pairs = np.unique(np.stack([w.row[hit["insults"]].astype(np.uint64), plain[hit["insults"]]]), axis=1)
        if pairs.size:
            kinds += np.bincount(pairs[0].astype(np.int64), minlength=rows)
        out[:, 1], out[:, 2], out[:, 3] = count(bad), count(bad) / n, kinds
        out[:, 4], out[:, 5] = count(hit["threats"]) / n, count(hit["profanity"]) / n
        out[:, 6], out[:, 7] = count(near), count(hit["you"]) / n
        lexicon.add(out, plain, w.row, n, y)
        out[:, 9], out[:, 12], out[:, 13], out[:, 14] = count(shouted) / n, count(mixed) / n, count(hidden), count(stretched) / n
    out[:, 0] = np.log1p(np.diff(w.ptr))
    out[:, 8] = K.per_row(_UPPER[data], offsets) / np.maximum(1, K.per_row(_LETTER[data], offsets))
    out[:, 10] = K.per_row(~_ALNUM[data] & ~K.SPACE[data], offsets) / size
    out[:, 11] = K.per_row(data == 33, offsets) / size
    return out


class Model:
    """The fitted forest and its calibration; small, and sent to the executors with the task."""

    def __init__(self, forest: boosting.Forest | None, knots: tuple[np.ndarray, np.ndarray] | None, lexicon: Lexicon):
        self.forest, self.knots, self.lexicon = forest, knots, lexicon

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.zeros(len(x))
        raw = self.forest.predict(x)
        # the calibrated value decides; the raw one orders what it ties
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * raw, 0, 1)


def held_out() -> str:
    return "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"


def _fold(x: np.ndarray) -> np.ndarray:
    """A fifth of the training rows, by their features, so that equal texts fall on one side."""
    h = K.mix(x.view(np.uint64).sum(axis=1, dtype=np.uint64))
    return h % np.uint64(5) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as double) y").filter(f"doc_id is not null and y is not null and not {held_out()}")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)

    # the sample has a proven bound, so the texts stay where they are
    joined = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for at, data, offsets in K.slices(batch.column("text")):
                h, row = words_of(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(y[at + row])], ["h", "y"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(offsets) - 1, pa.int64()), pa.array(y[at : at + len(offsets) - 1])], ["h", "y"])  # the rows themselves

    counts = joined.mapInArrow(shared.tidy(words), "h long, y double").groupBy("h").agg(F.sum("y").cast("long").alias("a"), F.count("y").alias("n"))
    counts = counts.filter(f"h is null or a >= {LEARNED_ROWS} and ln((a + 0.5) / (n - a + 0.5)) >= -3").toArrow().to_pydict()
    total = {h: (a, n) for h, a, n in zip(counts["h"], counts["a"], counts["n"], strict=True)}
    toxic, every = total.pop(None, (0, 0))
    odds = {h: np.log((a + 0.5) / (toxic + 1)) - np.log((n - a + 0.5) / (every - toxic + 1)) for h, (a, n) in total.items()}
    known = sorted(h for h, v in odds.items() if v >= LEARNED_ODDS)
    lexicon = Lexicon(np.array(known, np.int64).view(np.uint64), np.array([total[h][0] for h in known]), np.array([total[h][1] - total[h][0] for h in known]), toxic, every - toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for at, data, offsets in K.slices(batch.column("text")):
                own = y[at : at + len(offsets) - 1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(own)), pa.array(own), pa.array(list(features(data, offsets, lexicon, own)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # a row for each label, however many rows have its id
    got = joined.mapInArrow(shared.tidy(run), "doc_id long, y double, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()
    y = got["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model(None, None, lexicon)
    x = np.stack(got["x"].to_numpy(zero_copy_only=False))
    order = np.lexsort([*x.T, y])  # the same rows in any order give the same model
    x, y = np.ascontiguousarray(x[order]), y[order]
    check = _fold(x)
    if len(np.unique(y[check])) < 2 or len(np.unique(y[~check])) < 2:
        check = np.zeros(len(y), bool)
    forest = boosting.fit(x[~check], y[~check])
    return Model(forest, boosting.isotonic(forest.predict(x[check] if check.any() else x), y[check] if check.any() else y), lexicon)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                s = model.score(features(data, offsets, model.lexicon))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(s)), batch.column("held_out").slice(at, len(s)), pa.array(s), pa.array((s >= TOXIC).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", f"{held_out()} held_out").mapInArrow(shared.tidy(run), "doc_id long, held_out boolean, score double, predicted int")
