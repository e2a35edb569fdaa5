"""Line dedup by a tree of line templates.

A line's words are masked where they hold digits. The tree has a fixed depth: the number of words,
then the first DEPTH masked words. Below a leaf, the places after those are cut into one run more
than a template may have wildcards (SIMILAR of all places must agree), so two lines that agree in so
many places share a run. The earliest line of a run names a template: a line falls under it if
SIMILAR of the places agree, the others being its wildcards. A template recurs if lines of two
documents fall under it. Such lines stay in the first document that has the template, the one with
the smallest doc_id, and are dropped from all others. A line of fewer than MIN_WORDS words is a
template without wildcards, and recurs if it stands in SHORT_ROWS rows and two documents.

With every, each line names a template, not only the earliest of a run: a line falls under any line of
its leaf of which SIMILAR of the places agree. The earliest of a run is tried first; lines that it
doesn't settle are compared with all others of the run that come before what they fall under so far,
in pairs of blocks: bounded memory, quadratic only in lines that no earliest line settles.

Every other step is an aggregation or an equality join over distinct masked lines, so neither a line that
a third of all documents have nor a leaf or run with very many lines is one task's work, and the
result doesn't depend on how the rows are dealt.

Null and empty texts are kept as they are. Rows that share a doc_id are one document, whatever their
texts: none is the first one's copy, and a line to be dropped is dropped from all of them. Null
doc_id: the row keeps all its lines and counts for nothing. Lines repeated within one document are
no repetition across documents. Ties: the smallest doc_id keeps the line; among its lines the one
with the smallest hash names the template. Other columns pass through clean() untouched, but n_chars
follows the text. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import shared

DEPTH, MIN_WORDS, SIMILAR = 3, 4, 0.8
#: Rows in which a line of fewer than MIN_WORDS words recurs.
SHORT_ROWS = 4
FILTER_BITS = 26
#: Bytes of templates' words that may be broadcast; measured before.
BROADCAST_BYTES = 16 << 20
#: Lines of a block, and bytes of their words, by expectation.
BLOCK_LINES, BLOCK_BYTES = 4096, 8 << 20
U = np.uint64
_MASK = U(0x3C6EF372FE94F82B)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """The lines of some texts: each one's row, byte span, masked words, leaf and hash (0: too short to count)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = K.Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        rows = len(offsets) - 1
        at = np.searchsorted(offsets[1:], breaks, "right")
        self.row = np.repeat(np.arange(rows), np.bincount(at, minlength=rows) + 1)
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        first = np.searchsorted(self.row, np.arange(rows))
        self.end = np.append(self.start[1:], 0) - 1
        self.end[np.append(first[1:], len(self.row)) - 1] = offsets[1:]
        masked = words.hashes()
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        masked[digits[words.end] > digits[words.start]] = _MASK
        self.masked = masked
        line = np.searchsorted(breaks, words.start) + words.row
        self.ptr = np.searchsorted(line, np.arange(len(self.row) + 1))
        n = np.diff(self.ptr)
        self.hash, self.leaf = np.zeros(len(n), U), np.zeros(len(n), U)
        use = np.flatnonzero(n)
        if len(use):
            key = K.mix(n[use].astype(U))
            for k in range(DEPTH):
                there = n[use] > k
                key[there] = K.mix(key[there] * U(0xA24BAED4963EE407) + masked[self.ptr[use[there]] + k])
            self.leaf[use] = key & ~U(2) | U(1) | np.where(n[use] < MIN_WORDS, U(2), U(0))
            self.hash[use] = K.span_hash(masked, self.ptr[use], self.ptr[use + 1]) | U(1)


def _ids(batch: pa.RecordBatch, at: int, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Each line's doc_id, and whether it counts: long enough, and the first of its kind in its document."""
    col = batch.column("doc_id").slice(at, int(lines.row[-1]) + 1)
    ids, known = col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
    use = np.flatnonzero((lines.hash != 0) & known[lines.row])
    order = use[np.lexsort((lines.hash[use], lines.row[use]))]
    h, r = lines.hash[order], lines.row[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return ids[lines.row], order[fresh]


def _slot(leaf: np.ndarray) -> np.ndarray:
    return (leaf >> U(64 - FILTER_BITS)).astype(np.int64)


def _runs(kinds: DataFrame) -> DataFrame:
    """(run, leaf, line, first): the runs of words of each line (leaf, line, first, words), one more than it may have wildcards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, sizes = [], []
                for leaf, value in zip(part.column("leaf").to_numpy(), part.column("words"), strict=True):
                    words = np.frombuffer(value.as_buffer(), np.uint32)
                    wild = len(words) - math.ceil(SIMILAR * len(words) - 1e-9)
                    edges = np.linspace(DEPTH, len(words), wild + 2).astype(np.int64) if wild else np.zeros(1, np.int64)
                    found = K.span_hash(K.mix(words.astype(U) + U(1)), edges[:-1], edges[1:])
                    # the same words in another place or leaf are another run
                    keys.append(K.mix(found + K.mix(edges[:-1].astype(U) + np.int64(leaf).view(U))))
                    sizes.append(len(found))
                repeat = lambda c, sizes=sizes, part=part: pa.array(np.repeat(part.column(c).to_numpy(), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), repeat("leaf"), repeat("line"), repeat("first")], ["run", "leaf", "line", "first"])

    return kinds.mapInArrow(shared.tidy(cut), "run long, leaf long, line long, first long")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Those of pairs (leaf, line, words, top, top_words) of which SIMILAR of the places agree, as (leaf, line, top)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("words"), batch.column("top_words"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                good[i] = len(x) == len(y) and np.count_nonzero(x == y) >= SIMILAR * len(x) - 1e-9
            yield batch.select(["leaf", "line", "top"]).filter(pa.array(good))

    return pairs.mapInArrow(shared.tidy(run), "leaf long, line long, top long")


def _earlier(cells: DataFrame) -> DataFrame:
    """(leaf, line, earliest) from rows (run, i, j, ask, leaf, line, at, words): of each cell, asking lines with the least at of the others they agree with, if that is below their own."""

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ask, at = rows["ask"].to_numpy(), rows["at"].to_numpy()
        words = [np.frombuffer(v.as_buffer(), np.uint32) for v in rows["words"]]
        found = np.full(len(ask), np.iinfo(np.int64).max)
        for n in {len(w) for w in words}:
            size = np.array([len(w) == n for w in words])
            others, asking = np.flatnonzero(size & ~ask), np.flatnonzero(size & ask)
            if len(others) and len(asking):
                table = np.stack([words[k] for k in others])
                for k in asking:
                    good = (table == words[k]).sum(1) >= SIMILAR * n - 1e-9
                    found[k] = at[others[good]].min(initial=found[k])
        good = pa.array(ask & (found < at))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in (rows["leaf"].filter(good), rows["line"].filter(good), pa.chunked_array([found]).filter(good))], ["leaf", "line", "earliest"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("run", "i", "j")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if key != (now := tuple(int(c[lo]) for c in cols)):
                    if held:
                        yield finish(held)
                    key, held = now, []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield finish(held)

    return cells.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(shared.tidy(meet), "leaf long, line long, earliest long")


def _unsettled(kinds: DataFrame, hits: DataFrame, under: DataFrame) -> DataFrame:
    """(leaf, line, earliest): what under lacks, as the earliest line of a run does not agree. hits: written rows (run, leaf, line, first, top, low), low being the first document of the run's earliest line."""
    asks = hits.join(under, ["leaf", "line"], "left").withColumn("at", F.least("first", "earliest")).filter("at > low")
    asks = shared.written(asks.selectExpr("run", "leaf", "line", "at", "true ask"), "asks")
    until = shared.bounded(shared.written(asks.groupBy("run").agg(F.max("at").alias("until")), "until"))
    others = hits.join(until, "run").filter("first < until").selectExpr("run", "leaf", "line", "first at", "false ask")
    rows = shared.written(asks.unionByName(others).join(kinds.select("leaf", "line", "words"), ["leaf", "line"]), "unsettled")
    sizes = rows.groupBy("run").agg(F.count_if("ask").alias("a"), F.count_if(~F.col("ask")).alias("o"), F.max(F.octet_length("words")).alias("w")).filter("a > 0 and o > 0")
    per = f"greatest(1, least({BLOCK_LINES}, {BLOCK_BYTES} div w))"
    sizes = shared.written(sizes.selectExpr("run", f"cast(ceil(a / {per}) as long) a", f"cast(ceil(o / {per}) as long) o"), "sizes")
    cells = rows.join(shared.bounded(sizes), "run").withColumn("own", F.expr("pmod(xxhash64(line), if(ask, a, o))")).withColumn("other", F.expr("explode(sequence(0L, if(ask, o, a) - 1))"))
    return _earlier(cells.selectExpr("run", "if(ask, own, other) i", "if(ask, other, own) j", "ask", "leaf", "line", "at", "words"))


def templates(kinds: DataFrame, every: bool = False) -> DataFrame:
    """(leaf, line, earliest): for lines that fall under other lines' templates, the first document of the earliest. kinds: written rows (leaf, line, first, words)."""
    runs = shared.written(_runs(kinds.select("leaf", "line", "first", "words")), "runs")
    tops = runs.groupBy("run").agg(F.min(F.struct("first", "line")).alias("top"), F.count("*").alias("c")).filter("c > 1").selectExpr("run", "top.line top", "top.first low")
    hits = runs.join(shared.bounded(shared.written(tops, "tops")), "run").filter("line <> top")
    hits = shared.written(hits, "hits") if every else hits
    met = shared.written(hits.select("leaf", "line", "top").distinct(), "met")
    named = kinds.join(met.selectExpr("leaf", "top line").distinct(), ["leaf", "line"], "left_semi")
    named = shared.written(named.selectExpr("leaf", "line top", "words top_words", "first earliest"), "named")
    size = named.agg(F.sum(F.octet_length("top_words") + 64)).first()[0] or 0
    named = F.broadcast(named) if size <= BROADCAST_BYTES else named
    pairs = met.join(kinds.select("leaf", "line", "words"), ["leaf", "line"]).join(named.drop("earliest"), ["leaf", "top"])
    under = _agreeing(pairs.select("leaf", "line", "words", "top", "top_words")).join(named.drop("top_words"), ["leaf", "top"])
    under = under.groupBy("leaf", "line").agg(F.min("earliest").alias("earliest"))
    if not every:
        return under
    under = shared.written(under, "under")
    return under.unionByName(_unsettled(kinds, hits, under)).groupBy("leaf", "line").agg(F.min("earliest").alias("earliest"))


def repeated_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, drop): for each document that has any, the hashes of its lines to drop."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                x = Lines(data, offsets)
                ids, use = _ids(batch, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(x.leaf[use].view(np.int64)), pa.array(x.hash[use].view(np.int64)), pa.array(ids[use])], ["leaf", "line", "doc_id"])

    stats = docs.mapInArrow(shared.tidy(leaves), "leaf long, line long, doc_id long").groupBy("leaf")
    stats = stats.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("line").alias("l"), F.max("line").alias("m"), F.count("*").alias("c"))
    stats = stats.filter(f"a < b and (leaf & 2 = 0 or c >= {SHORT_ROWS})")
    stats = shared.written(stats.selectExpr("leaf", "l < m and leaf & 2 = 0 mixed", f"shiftrightunsigned(leaf, {64 - FILTER_BITS}) slot"), "leaves")
    wanted, mixed = shared.bitmap(stats, FILTER_BITS), shared.bitmap(stats.filter("mixed"), FILTER_BITS)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                x = Lines(data, offsets)
                ids, use = _ids(batch, at, x)
                slot = _slot(x.leaf[use])
                there = shared.in_bitmap(wanted, slot)
                use, slot = use[there], slot[there]
                short = (x.masked >> U(32)).astype(np.uint32)
                words = [short[x.ptr[k] : x.ptr[k + 1]].tobytes() if m else None for k, m in zip(use, shared.in_bitmap(mixed, slot), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.leaf[use].view(np.int64)), pa.array(x.hash[use].view(np.int64)), pa.array(ids[use]), pa.array(words, pa.binary())], ["leaf", "line", "doc_id", "words"])

    found = docs.mapInArrow(shared.tidy(again), "leaf long, line long, doc_id long, words binary")
    found = shared.written(found.join(stats.select("leaf", "mixed"), "leaf"), "lines")
    kinds = found.groupBy("leaf", "line", "mixed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("words").alias("words"))
    kinds = shared.written(kinds, "kinds")
    under = templates(kinds.filter("mixed").select("leaf", "line", "first", "words"), every)
    owned = kinds.select("leaf", "line", "first", "last").join(under, ["leaf", "line"], "left")
    owned = owned.selectExpr("leaf", "line", "least(first, earliest) owner", "last").filter("owner < last").drop("last")
    owned = shared.bounded(shared.written(owned, "owned"))
    drops = found.select("leaf", "line", "doc_id").join(owned, ["leaf", "line"]).filter("doc_id <> owner")
    return drops.groupBy("doc_id").agg(F.collect_set("line").alias("drop"))


RESULT = ["n_lines", "n_dropped", "n_words", "words_dropped", "text"]


def _rewritten(docs: DataFrame, keep: list[str], every: bool) -> DataFrame:
    """The columns of keep as k0, k1 and so on, and those of RESULT."""
    drops = repeated_lines(docs, every).withColumnRenamed("doc_id", "_id")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col("text"), F.col("doc_id").cast("long").alias("_own")).join(drops, F.col("_own") == F.col("_id"), "left").drop("_id", "_own")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*(f"k{i}" for i in range(len(keep)))).schema.fields)
    names = [*(f"k{i}" for i in range(len(keep))), *RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                x = Lines(data, offsets)
                rows = len(offsets) - 1
                n, words = np.bincount(x.row, minlength=rows), np.diff(x.ptr)
                first = np.concatenate([[0], np.cumsum(n)])
                part = batch.slice(at, rows)
                texts, dropped, lost = [], np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                given, drop = part.column("text"), part.column("drop")
                for i in range(rows):
                    if not drop[i].is_valid:
                        texts.append(given[i].as_py())
                        continue
                    own = range(first[i], first[i + 1])
                    bad = np.isin(x.hash[own.start : own.stop].view(np.int64), np.array(drop[i].as_py(), np.int64))
                    dropped[i], lost[i] = bad.sum(), words[own.start : own.stop][bad].sum()
                    texts.append(b"\n".join(data[x.start[k] : x.end[k]].tobytes() for k in own if not bad[k - own.start]).decode("utf-8", "replace"))
                counts = (n, dropped, np.bincount(x.row, words, rows), lost)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(texts, pa.string())], names)

    return rows.mapInArrow(shared.tidy(run), f"{fields}n_lines long, n_dropped long, n_words long, words_dropped long, text string")


def deduplicated(docs: DataFrame, keep: list[str], every: bool = False) -> DataFrame:
    """The columns of keep, with n_lines, n_dropped, n_words, words_dropped and the text without the lines dropped; these replace columns of the same name."""
    keep = [c for c in keep if c not in RESULT]
    return _rewritten(docs, keep, every).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *RESULT)


def clean(docs: DataFrame, every: bool = False) -> DataFrame:
    """The documents' own columns with repeated lines dropped; documents go that have no word left of those they had."""
    keep = [c for c in docs.columns if c != "text"]
    out = _rewritten(docs, keep, every).filter("words_dropped = 0 or words_dropped < n_words")
    column = {c: F.col(f"k{i}") for i, c in enumerate(keep)} | {"text": F.col("text")}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column["n_chars"])
    return out.select(*(column[c].alias(c) for c in docs.columns))
