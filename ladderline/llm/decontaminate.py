"""Benchmark decontamination by canonical templates.

Words lose case and punctuation; numbers, names and units become typed placeholders, with the word
that stood there as the slot's value. Windows of WINDOW canonical words, LITERALS of them or more
literal, are hashed; an item with fewer words is one window of its own length. A fixed-size bitmap of the benchmark's windows keeps other windows of the
documents from being emitted; what passes is hash-joined with the benchmark's windows. Along one
alignment of a document and an item, a benchmark value must always meet the same value: then the
document holds the item, perhaps re-parameterised. A document is contaminated by an item of which
the consistent alignments hold WINDOWS windows or more (13 words in a row, say), or all it has.
Items without a window (those with too few literal words) get windows of WINDOW words in which an
operator that stands between two numbers is a word too, with one word of letters at least; they are
contaminating if all of these (or WINDOWS of them) are met. They are also looked for whole: all their
words, slot values included, in a row are one key of the item's own length, joined exactly.

Items with the same canonical words, and equal slot values in the same places, are one class: no value
of theirs can make one of them consistent and another not. A document is joined with classes, never
with each item of a template; item_id is a class's smallest item, n_items counts its members, and
members() lists them. A class is re-parameterised in a document if a window met there has values that
no member has in that place.

Each window is taken twice where it has names: with names as placeholders, and with names as words,
so that a copy in other case is found too. Null and empty texts hold nothing. Rows that share a
doc_id are one document, whatever their texts: a row each, with the items of all of them together;
so are items that share an item_id. Null doc_id: the row stays, never contaminated. Null items and items
without words match nothing; an item of one word matches every text with that word. Other columns are ignored.
An empty table gives no rows; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import shared

WINDOW, LITERALS, WINDOWS = 8, 4, 6
#: Least share of a benchmark item's slot values that always meet the same value.
CONSISTENT = 0.8
FILTER_BITS = 24
#: What stands for the size of windows with operators as words.
ARITHMETIC = -WINDOW
U = np.uint64
#: Units that count as such after a number.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ton tons tonne tonnes l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degree degrees c f kph mph kmh".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True
_OPERATOR = np.zeros(256, bool)
_OPERATOR[list(b"+-*/=<>^")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_NUM, _NAME, _UNIT = U(0x1111111111111111), U(0x2222222222222222), U(0x3333333333333333)
_UNITS = np.unique(np.array([K.word_hash(u) for u in UNITS], U))


def _operators(data: np.ndarray, words: K.Words) -> np.ndarray:
    """The bytes of words that are an operator between two numbers."""
    total = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    digits, signs = total(_DIGIT), total(_OPERATOR)
    number = digits[words.end] > digits[words.start]
    between = signs[words.end] - signs[words.start] == words.end - words.start
    if len(between):
        joined = words.row[1:] == words.row[:-1]
        between[1:] &= number[:-1] & joined
        between[:-1] &= number[1:] & joined
        between[[0, -1]] = False
    edges = np.zeros(len(data) + 1, np.int64)
    edges[words.start[between]] += 1
    edges[words.end[between]] -= 1
    return np.cumsum(edges[:-1]) > 0


class Canonical:
    """The canonical words of some texts: typed and plain hashes, slot values, and each row's range. With arithmetic, operators between numbers are words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, arithmetic: bool = False):
        words = K.Words(data, offsets)
        self.arithmetic = arithmetic
        low = K.LOWER[data]
        # capital letters with accents (0xC3 0x80-0x9E) have their small ones 0x20 further
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        accented = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = np.where(accented, data + 0x20, low).astype(np.uint8)
        capital = ((data >= 65) & (data <= 90)) | (np.append(accented[1:], False))
        kept = _LETTER[data] | _DIGIT[data]
        if arithmetic:
            kept = kept | _operators(data, words)
        total = np.concatenate([[0], np.cumsum(kept)])
        has = total[words.end] > total[words.start]
        start, end, row = words.start[has], words.end[has], words.row[has]
        at = np.flatnonzero(kept)
        value = K.span_hash(K._BYTE[low[kept]], total[start], total[end])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[end] > digits[start]
        unit = np.zeros(len(value), bool)
        unit[1:] = number[:-1] & (row[1:] == row[:-1]) & np.isin(value[1:], _UNITS)
        first = at[total[start]] if len(start) else start
        small = np.concatenate([[0], np.cumsum(_LOW[data] | (after & (data >= 0xA0)))])
        begins = np.ones(len(value), bool)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        begins[1:] = (row[1:] != row[:-1]) | _STOP[data[np.maximum(end[:-1] - 1, 0)]] | (breaks[start[1:]] > breaks[end[:-1]])
        name = ~begins & ~number & ~unit & capital[first] & (small[end] > small[start]) if len(value) else begins[:0]
        self.value = value
        self.plain = np.where(number, _NUM, np.where(unit, _UNIT, value))
        self.typed = np.where(name, _NAME, self.plain)
        self.slot_plain, self.slot_typed, self.name = number | unit, number | unit | name, name
        self.ptr = np.searchsorted(row, np.arange(len(offsets)))
        self.row = row
        if arithmetic:
            letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
            symbol = np.concatenate([[0], np.cumsum(_LETTER[data] | _DIGIT[data])])
            self.letter, self.operator = letters[end] > letters[start], symbol[end] == symbol[start]

    def forms(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's form, the same for rows with the same typed words and equal slot values in the same places; and each word's label in its form: where its value stands first."""
        at = np.flatnonzero(self.slot_typed)
        at = at[np.lexsort((at, self.value[at], self.row[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (self.value[at][1:] != self.value[at][:-1]) | (self.row[at][1:] != self.row[at][:-1])
        place = np.zeros(len(self.value), U)
        if len(at):
            place[at] = (at[new][np.cumsum(new) - 1] - self.ptr[self.row[at]] + 1).astype(U)
        form = K.span_hash(K.mix(self.typed + K.mix(place.copy())), self.ptr[:-1], self.ptr[1:])
        return form, place + form[self.row]

    def windows(self, size: int = WINDOW, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, key, slot flags of the words) of all windows, or only of those that are a whole text: typed ones, and plain ones where they differ."""
        n = len(self.value) - size + 1
        if n <= 0:
            return
        one_row = self.row[:n] == self.row[size - 1 :]
        if whole:
            one_row &= np.diff(np.append(self.ptr, len(self.value)))[self.row[:n]] == size
        count = lambda flag: (c := np.concatenate([[0], np.cumsum(flag)]))[size:] - c[:-size]
        for words, slots, extra in ((self.typed, self.slot_typed, True), (self.plain, self.slot_plain, False)):
            good = one_row & (count(slots) <= size - LITERALS)
            if not extra:
                good &= count(self.name) > 0
            if self.arithmetic:
                good &= (count(self.operator) > 0) & (count(self.letter & ~slots) > 0)
            pos = np.flatnonzero(good)
            key = K.windows(words, size)[pos]
            yield pos, K.mix(key + U(1 << 32)) if self.arithmetic else key if size == WINDOW else K.mix(key + U(size)), slots


def _rows(values: np.ndarray, pos: np.ndarray, slots: np.ndarray, size: int) -> pa.Array:
    """The values, or labels, of the slots of each window."""
    flags = np.lib.stride_tricks.sliding_window_view(slots, size)[pos] if len(pos) else np.zeros((0, size), bool)
    values = np.lib.stride_tricks.sliding_window_view(values, size)[pos] if len(pos) else np.zeros((0, size), U)
    ptr = np.concatenate([[0], np.cumsum(flags.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ptr), pa.array(values[flags].view(np.int64)))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of slices of rows (id, text) that have an id."""
    for batch in batches:
        batch = batch.filter(batch.column("id").is_valid())
        for at, data, offsets in K.slices(batch.column("text")):
            yield batch.column("id").slice(at, len(offsets) - 1), data, offsets


WINDOWS_OF = "at long, size int, key long, value long, slots array<long>"
_SIZES = [(WINDOW, False), *((k, True) for k in range(LITERALS, WINDOW))]


def _table(ids: pa.Array, c: Canonical, size: int, pos: np.ndarray, key: np.ndarray, slots: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    """The columns id and WINDOWS_OF."""
    width = abs(size)
    value = K.windows(c.value, width)[pos]
    return [ids.take(pa.array(c.row[pos])), pa.array(pos - c.ptr[c.row[pos]]), pa.array(np.full(len(pos), size, np.int32)), _long(key), _long(value), _rows(values, pos, slots, width)]


def windows_of(rows: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """The windows of such sizes of rows (id, text), of those the bitmap lets pass, with the slots' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches):
            for arithmetic in sorted({size < 0 for size in sizes}):
                c = Canonical(data, offsets, arithmetic)
                for size in sizes:
                    if (size < 0) != arithmetic:
                        continue
                    for pos, key, slots in c.windows(abs(size)):
                        there = shared.in_bitmap(bitmap, (key >> U(64 - FILTER_BITS)).astype(np.int64))
                        if there.any():
                            yield pa.RecordBatch.from_arrays(_table(ids, c, size, pos[there], key[there], slots, c.value), ["id", "at", "size", "key", "value", "slots"])

    return rows.mapInArrow(shared.tidy(run), f"id long, {WINDOWS_OF}")


def _own_windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[Canonical, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(canonical, size, first word, key, slot flags) of the items' own windows: those with operators only of rows without others."""
    c = Canonical(data, offsets)
    usual = np.zeros(len(offsets) - 1, bool)
    for size, whole in _SIZES:
        for pos, key, slots in c.windows(size, whole):
            usual[c.row[pos]] = True
            yield c, size, pos, key, slots
    c = Canonical(data, offsets, True)
    for pos, key, slots in c.windows(WINDOW):
        bare = ~usual[c.row[pos]]
        yield c, ARITHMETIC, pos[bare], key[bare], slots


def item_windows(rows: DataFrame) -> DataFrame:
    """(item_id, WINDOWS_OF) of the benchmark's rows (id, text), with the slots' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches):
            for c, size, pos, key, slots in _own_windows(data, offsets):
                if len(pos):
                    yield pa.RecordBatch.from_arrays(_table(ids, c, size, pos, key, slots, c.forms()[1]), ["item_id", "at", "size", "key", "value", "slots"])

    return rows.mapInArrow(shared.tidy(run), f"item_id long, {WINDOWS_OF}")


def _whole_key(words: np.ndarray, length: int) -> np.ndarray:
    return K.mix(K.windows(words, length) + U(length))


def item_forms(rows: DataFrame) -> DataFrame:
    """(item_id, form, length, key) of each of the benchmark's rows (id, text) with words: its form, and the key of all its words. The form of a row without windows is that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches):
            c = Canonical(data, offsets)
            length = np.diff(c.ptr)
            key = np.array([_whole_key(c.value[a:b], int(b - a))[0] if b > a else 0 for a, b in zip(c.ptr[:-1], c.ptr[1:], strict=True)], U)
            form = key.copy()
            for own, _, pos, _, _ in _own_windows(data, offsets):
                have = np.unique(own.row[pos])
                form[have] = own.forms()[0][have]
            there = np.flatnonzero(length)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(there)), _long(form[there]), pa.array(length[there].astype(np.int32)), _long(key[there])], ["item_id", "form", "length", "key"])

    return rows.mapInArrow(shared.tidy(run), "item_id long, form long, length int, key long")


def whole_hits(rows: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """(doc_id, key) of the runs of words of such lengths in rows (id, text), of those the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            for at, data, offsets in K.slices(batch.column("text")):
                c = Canonical(data, offsets)
                ids = batch.column("id").to_numpy()
                for length in lengths:
                    key = _whole_key(c.value, length)
                    if not len(key):
                        break
                    good = c.row[: len(key)] == c.row[length - 1 :]
                    pos = np.flatnonzero(good & shared.in_bitmap(bitmap, (key >> U(64 - FILTER_BITS)).astype(np.int64)))
                    if len(pos):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + c.row[pos]]), pa.array(key[pos].view(np.int64))], ["doc_id", "key"])

    return rows.mapInArrow(shared.tidy(run), "doc_id long, key long")


def _members(forms: DataFrame) -> DataFrame:
    """(item_id, class_id, n_items), written, of items by the forms of their rows."""
    items = forms.select("item_id", "form").distinct().groupBy("item_id").agg(F.bit_xor("form").alias("form"), F.count("*").alias("rows"))
    items = shared.written(items, "items")
    classes = shared.bounded(shared.written(items.groupBy("form", "rows").agg(F.min("item_id").alias("class_id"), F.count("*").alias("n_items")), "classes"))
    return shared.written(items.join(classes, ["form", "rows"]).select("item_id", "class_id", "n_items"), "members")


def members(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id, n_items): the class of each item with words, named by its smallest item."""
    return _members(item_forms(benchmark.selectExpr("cast(item_id as long) id", "text")))


def _whole_matches(docs: DataFrame, whole: DataFrame) -> DataFrame | None:
    """(doc_id, class_id) of documents that hold all the words of a row of whole (class_id, length, key), or None if there are no such rows."""
    lengths = sorted(r["length"] for r in whole.select("length").distinct().collect())
    if not lengths:
        return None
    bitmap = shared.bitmap(whole.selectExpr(f"shiftrightunsigned(key, {64 - FILTER_BITS}) slot"), FILTER_BITS)
    return whole_hits(docs, lengths, bitmap).distinct().join(whole.select("class_id", "key"), "key").select("doc_id", "class_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_items, matched, coverage, reparameterised) of documents and the classes of items that contaminate them."""
    questions, rows = benchmark.selectExpr("cast(item_id as long) id", "text"), docs.selectExpr("cast(doc_id as long) id", "text")
    forms = shared.written(item_forms(questions), "forms")
    member = _members(forms)
    own = shared.written(item_windows(questions).join(shared.bounded(member.drop("n_items")), "item_id"), "benchmark")
    usual = shared.bounded(shared.written(own.filter("size > 0").select("item_id").distinct(), "usual"))
    own = own.filter("size > 0").unionByName(own.filter("size < 0").join(usual, "item_id", "left_anti"))
    # what all members of a class share, once
    items = shared.written(own.selectExpr("class_id", "at", "size", "key", "slots labels").distinct(), "windows")
    values = shared.bounded(shared.written(own.select("class_id", "at", "size", "value").distinct(), "values"))
    bitmap = shared.bitmap(items.selectExpr(f"shiftrightunsigned(key, {64 - FILTER_BITS}) slot"), FILTER_BITS)
    # an item of several rows may have windows of several sizes
    sizes = items.groupBy("class_id", "size").agg(F.count_distinct("at").alias("windows"))
    lengths = sorted(r["size"] for r in sizes.select("size").distinct().collect())
    hits = windows_of(rows, bitmap, lengths).withColumnsRenamed({"id": "doc_id", "at": "pos"})
    met = hits.join(shared.bounded(items), ["key", "size"]).join(values.withColumn("verbatim", F.lit(True)), ["class_id", "at", "size", "value"], "left")
    met = met.selectExpr("doc_id", "class_id", "size", "at", "pos - at shift", "verbatim is null changed", "zip_with(labels, slots, (o, v) -> named_struct('o', o, 'v', v)) pairs")
    # one alignment has a window of the item once at most, so a group is no larger than the item
    line = met.groupBy("doc_id", "class_id", "size", "shift").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.max("changed").alias("changed"))
    line = line.filter(f"size(pairs) = 0 or size(array_distinct(pairs.o)) >= {CONSISTENT} * size(pairs)")
    parts = line.selectExpr("doc_id", "class_id", "size", "explode(at) at", "changed")
    found = parts.groupBy("doc_id", "class_id", "size").agg(F.count_distinct("at").alias("matched"), F.max("changed").alias("changed"))
    found = found.join(shared.bounded(shared.written(sizes, "sizes")), ["class_id", "size"]).filter(f"matched >= least({WINDOWS}, windows)")
    found = found.selectExpr("doc_id", "class_id", "matched", "matched / windows coverage", "changed")
    whole = forms.join(usual, "item_id", "left_anti").join(shared.bounded(member.drop("n_items")), "item_id").select("class_id", "length", "key").distinct()
    whole = _whole_matches(rows, shared.written(whole, "whole"))
    if whole is not None:
        found = found.unionByName(whole.selectExpr("doc_id", "class_id", "1L matched", "1D coverage", "false changed"))
    found = found.groupBy("doc_id", "class_id").agg(F.max("matched").alias("matched"), F.max("coverage").alias("coverage"), F.min("changed").alias("reparameterised"))
    counts = shared.bounded(shared.written(member.select("class_id", "n_items").distinct(), "counts"))
    return found.join(counts, "class_id").selectExpr("doc_id", "class_id item_id", "n_items", "matched", "coverage", "reparameterised")


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: contaminated, the classes of its items by their smallest ones, the greatest coverage, whether an item is re-parameterised, and how many items the classes have."""
    found = matches(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("n_items").alias("n_items"), F.max("coverage").alias("coverage"), F.max("reparameterised").alias("reparameterised"))
    found = shared.written(found, "contaminated")
    rows = docs.selectExpr("cast(doc_id as long) doc_id").join(found, "doc_id", "left")
    return rows.selectExpr("doc_id", "item_ids is not null contaminated", "coalesce(item_ids, cast(array() as array<long>)) item_ids", "coalesce(coverage, 0D) coverage", "coalesce(reparameterised, false) reparameterised", "coalesce(n_items, 0L) n_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    own = shared.fresh(docs, "_bad")
    bad = shared.written(matches(docs, benchmark).select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.join(shared.bounded(bad), F.col("doc_id") == F.col(own), "left_anti")
