"""Secret scan: fixed formats, and random strings told from identifiers by two character Markov models.

Base spans are the leftmost non-overlapping matches of each kind: assign (a keyword, a separator and a
value of 8 characters or more), access (AKIA and capitals or digits, 16 or more) and hex (32 or more).
A span is the whole match, in code points.

Beside them every run of CANDIDATE, without the sign = at its ends, that meets no base span is a candidate. Two Markov models
of ORDER, one of random strings and one of ordinary identifiers, give each character a probability
after those before it; the sum of their log ratios over the run is its score. A run whose score is over both the total
and the mean threshold is a span of kind random. Runs of digits alone (numbers), of letters in one case with or without a
capital at the start (words), and of at most three distinct signs (rulers) are no candidates.

Training. No table labels secrets, so the labelled samples are (1) random: what base kinds hold in the
sample, and invented keys, SAMPLE_KEYS of each of ALPHABETS with a fixed seed; (2) ordinary: at most SAMPLE_RUNS runs of the
texts of the SAMPLE_ROWS smallest hashes of doc_id (identifiers and words that no base span covers), and identifiers joined from
them and numbers in the usual styles. Nine tenths of each fit the models; the rest calibrates the thresholds: the
score that MISSED of the random runs stay below or, if it is higher, the one that one ordinary run in MISTAKES exceeds. The model depends on the sample's rows alone, not on how they are dealt.

Null and empty texts have no spans. A null doc_id stays null and trains nothing. Repeated rows get a row each. Other
columns are ignored. Work is linear in a text's length. An empty table gives no rows, and the models then know invented samples only.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
#: A text without any of these (in lower case) has no assignment.
KEYWORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{16,}")
PLAIN = re.compile("[0-9]+|[A-Za-z]?[a-z]+|[A-Z]+")
ORDER = 2
SAMPLE_ROWS, SAMPLE_RUNS, SAMPLE_KEYS = 2_000, 20_000, 1_500
#: Of so many held-out ordinary runs one may pass a threshold; of held-out random runs this share may stay below it.
MISTAKES, MISSED = 2_000, 0.01
#: The alphabets of invented keys.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
_CODE = np.zeros(256, np.int64)  # 0: none, or before the start
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_=-."):
    _CODE[ord(_c)] = _i + 1
SIGNS = 69


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds that are asked for."""
    out = []
    if kinds[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if kinds[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if kinds[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _spans(raw: bytes) -> tuple[str, list[tuple[int, int, int]]]:
    text, low = raw.decode(), raw.lower()
    return text, base_spans(text, (any(k in low for k in KEYWORDS), b"AKIA" in raw, True))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that meet no taken span and are no number, word or ruler."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        run = m.group()
        start, end = m.start() + len(run) - len(run.lstrip("=")), m.end() - (len(run) - len(run.rstrip("=")))
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= start and end - start >= 16 and not PLAIN.fullmatch(run := text[start:end]) and len(set(run)) > 3:
            out.append((start, end))
    return out


def _codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("latin-1", "replace"), np.uint8)]


def _contexts(run: str) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER signs before, the sign) of each place, as numbers."""
    codes = np.concatenate([np.zeros(ORDER, np.int64), _codes(run)])
    before = np.zeros(len(codes) - ORDER, np.int64)
    for k in range(ORDER):
        before = before * SIGNS + codes[k : len(codes) - ORDER + k]
    return before, codes[ORDER:]


def markov(runs: list[str]) -> np.ndarray:
    """log P(sign | signs before) of a model of ORDER, each order smoothed by the one below it."""
    joined = [_contexts(r) for r in runs]
    before, sign = (np.concatenate([np.zeros(0, np.int64), *(j[i] for j in joined)]) for i in range(2))
    p = np.full((1, SIGNS), 1 / SIGNS)
    for k in range(ORDER + 1):
        n = np.bincount(before % SIGNS**k * SIGNS + sign, minlength=SIGNS ** (k + 1)).reshape(-1, SIGNS)
        lower = np.tile(p, (SIGNS, 1)) if k else p
        p = (n + 4 * lower) / (n.sum(1, keepdims=True) + 4)
    return np.log(p)


@dataclass
class Model:
    """Log ratios of the two models, and the thresholds."""

    ratio: np.ndarray
    total: float = 0.0
    mean: float = 0.0

    def scores(self, run: str) -> tuple[float, float]:
        """Sum and mean of the log ratios."""
        found = self.ratio[_contexts(run)]
        return float(found.sum()), float(found.mean())

    def passes(self, run: str) -> bool:
        total, mean = self.scores(run)
        return total > self.total and mean > self.mean


def invented_keys(rng: np.random.Generator) -> list[str]:
    """Random strings of every alphabet, 16 to 64 long."""
    return ["".join(rng.choice(list(a), rng.integers(16, 65))) for a in ALPHABETS for _ in range(SAMPLE_KEYS)]


def joined_identifiers(words: list[str], rng: np.random.Generator) -> list[str]:
    """Identifiers in the usual styles, of words of the corpus and small numbers."""
    words = [w.lower() for w in words if w.isalpha() and w.isascii() and len(w) >= 3] or ["value", "count", "index", "name"]
    out = []
    for i in range(2 * SAMPLE_KEYS):
        parts = [words[k] for k in rng.integers(0, len(words), rng.integers(2, 6))]
        if i % 3 == 0:  # numbers, versions, years and dates
            year, month, day = rng.integers(1950, 2050), rng.integers(1, 13), rng.integers(1, 32)
            number = (str(rng.integers(0, 3000)), f"v{rng.integers(0, 20)}", str(year), f"{year}-{month:02}-{day:02}", f"{year}{month:02}{day:02}")[i // 3 % 5]
            parts.insert(int(rng.integers(0, len(parts) + 1)), number)
        style = i % 7
        if style < 2:
            parts = [parts[0], *(p.title() for p in parts[1:])] if style else [p.title() for p in parts]
        elif style == 6:
            parts = [p.upper() for p in parts]
        out.append(("", "", "_", "-", "/", "", "_")[style].join(parts))
    return out


def fit(random: list[str], ordinary: list[str]) -> Model:
    """Both models from nine tenths, thresholds from the rest; every tenth in the order of a checksum."""
    by = lambda runs: sorted(set(runs), key=lambda r: hashlib.sha256(r.encode()).digest())
    random, ordinary = by(random), by(ordinary)
    part = lambda runs, held: [r for i, r in enumerate(runs) if (i % 10 == 0) == held]
    model = Model(markov(part(random, False)) - markov(part(ordinary, False)))
    scores = lambda runs: np.array([model.scores(r) for r in part(runs, True) if len(r) >= 16] or [(0.0, 0.0)])
    low, high = scores(ordinary), scores(random)
    highest = lambda x: np.sort(x)[-1 - len(x) // MISTAKES]
    model.total, model.mean = (max(0.0, float(highest(low[:, k])), float(np.quantile(high[:, k], MISSED))) for k in range(2))
    return model


def train(docs: DataFrame) -> Model:
    """The model from the sample; at most SAMPLE_RUNS runs of each label reach the driver."""
    ids = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").filter("doc_id is not null")
    top = ids.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile("[A-Za-z0-9+/_=-]{6,}")
        for batch in batches:
            found: dict[tuple[str, bool], None] = {}
            for raw in batch.column("text"):
                if not raw.is_valid:
                    continue
                text, taken = _spans(raw.as_buffer().to_pybytes())
                found |= {(CANDIDATE.search(text[s:e]).group() if CANDIDATE.search(text[s:e]) else text[s:e][-8:], True): None for s, _, e in taken}
                rest, at = [], 0
                for s, _, e in taken:
                    rest.append(text[at:s])
                    at = max(at, e)
                rest.append(text[at:])
                found |= {(w[:64], False): None for r in rest for w in word.findall(r) if not w.isdecimal()}
            yield pa.RecordBatch.from_pydict({"run": pa.array([k[0] for k in found], pa.string()), "random": pa.array([k[1] for k in found], pa.bool_())})

    rows: list = []
    if top is not None:
        sample = ids.filter(F.xxhash64("doc_id") <= top).select("text").mapInArrow(shared.tidy(run), "run string, random boolean").distinct()
        rows = [r for flag in (True, False) for r in sample.filter(F.col("random") == flag).orderBy(F.xxhash64("run"), "run").limit(SAMPLE_RUNS).collect()]
    rng = np.random.default_rng(12)
    words = sorted(r["run"] for r in rows if not r["random"])
    return fit([*(r["run"] for r in rows if r["random"]), *invented_keys(rng)], [*words, *joined_identifiers(words, rng)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document of (doc_id, text): counts, digest of the base spans, and all spans, by start and then kind."""
    if model is None:
        model = train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIGNS**(ORDER + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for raw in batch.column("text"):
                text, base = _spans(raw.as_buffer().to_pybytes()) if raw.is_valid else ("", [])
                added = [(s, 3, e) for s, e in candidates(text, base) if model.passes(text[s:e])]
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((*n, len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, [*[pa.int64()] * 4, pa.string(), pa.string()], strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(shared.tidy(run), SCHEMA)
