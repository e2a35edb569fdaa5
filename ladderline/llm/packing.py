"""Best-fit packing of documents into sequences by the linear grouping scheme.

Lengths, not documents, are packed: at most `capacity` distinct ones, whatever the number of
documents. Large lengths are sorted, cut into groups of equal cardinality and rounded up to their
group's largest; the few sizes that remain are packed by a linear programme over configurations
(column generation with a knapsack as the pricing step). Whole multiples of each configuration are
kept, and actual lengths are substituted for the rounded ones: a place takes the longest length that
leaves the other places their sizes, which wins back what rounding up costs. What is left over, with
all small lengths, goes best-fit in descending order into the tightest place that holds it.

The plan is a bounded list of (length, ranks, sequences, offset). Documents get their rank within
their length by salted counting, so that a length that a third of all documents have is no hot key.

Null text: empty, so the end id alone. Null doc_id: packed, and null in the result. Repeated rows:
each is a document; equal pieces are interchangeable. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY = 1024
#: Groups of equal cardinality that the large lengths are rounded up to.
GROUPS = 120
#: A length is small below this share of the capacity.
SMALL = 1 / 4
#: Steps of column generation after which the programme's present solution is taken.
STEPS = 4000
#: Pieces of one salt of a length.
SALT_ROWS = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, memo: int = tokens.MEMO) -> DataFrame:
    """A row per piece: (doc_id, piece, start, length, ids_crc32[, ids]). Longer documents are cut; the first piece has what is over."""
    end = end_id.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, memo=memo)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(tokens.crc32(ids[4 * a : 4 * b]))
                    if with_ids:
                        out["ids"].append(np.frombuffer(ids[4 * a : 4 * b], "<u4").astype(np.int32))
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items() if with_ids or k != "ids"})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(shared.tidy(run), schema)


def _configurations(sizes: list[int], demand: list[float], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """A fractional optimum of the configuration programme: (how many of each size, how many bins)."""
    n = len(sizes)
    basis = [np.eye(n, dtype=np.int64)[k] * (capacity // sizes[k]) for k in range(n)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    amount = inverse @ (np.array(demand, float) * (1 + 1e-9 * np.arange(1, n + 1)))
    for _ in range(STEPS):
        price = inverse.sum(axis=0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for k in np.argsort(sizes, kind="stable"):
            if price[k] <= 1e-12:
                continue
            s = sizes[k]
            for j in range(s, capacity + 1, s):
                new = best[j - s : min(j, capacity + 1 - s)] + price[k]
                old = best[j : j + s]
                better = new > old + 1e-13
                old[better] = new[better]
                choice[j : j + s][better] = k
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n, np.int64), capacity
        while choice[c] >= 0:
            column[choice[c]] += 1
            c -= sizes[choice[c]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-10, amount / np.where(direction > 1e-10, direction, 1), np.inf)
        row = int(np.argmin(ratio))
        step = ratio[row]
        amount -= step * direction
        amount[row] = step
        inverse[row] /= direction[row]
        others = np.arange(n) != row
        inverse[others] -= direction[others, None] * inverse[row]
        basis[row] = column
    return [(tuple(b), float(a)) for b, a in zip(basis, np.maximum(amount, 0), strict=True)]


class _Bins:
    """Groups of alike bins: the lengths in them, how many there are, and the room left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        if count > 0:
            room = self.capacity - sum(lengths)
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].append((lengths, count))

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [x for room in self.rooms for x in self.by_room[room]]

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                many = self.capacity // length
                self.add((length,) * many, count // many)
                self.add((length,) * (count % many), 1 if count % many else 0)
                return
            room = self.rooms[at]
            lengths, there = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(at)
            used = min(there, count)
            self.add((*lengths, length), used)
            self.add(lengths, there - used)
            count -= used


def _grouped(counts: dict[int, int], groups: int) -> tuple[list[int], list[int]]:
    """Sizes and their demand: the lengths, longest first, cut into groups of equal cardinality and rounded up to their group's longest. Groups with the same longest length are one size."""
    share, room = -(-sum(counts.values()) // groups), 0
    demand: dict[int, int] = {}
    for n in sorted(counts, reverse=True):
        have = counts[n]
        while have:
            if room == 0:
                top, room = n, share
            take = min(room, have)
            demand[top] = demand.get(top, 0) + take
            room, have = room - take, have - take
    return list(demand), list(demand.values())


def _substituted(bins: _Bins, sizes: list[int], many: int, left: dict[int, int], lengths: list[int]) -> int:
    """Fills up to `many` bins of one configuration with actual lengths, which leave `left` and the sorted `lengths`; gives how many.

    Each place, the largest first, takes the longest length there is that leaves the places after
    it their sizes, so what rounding up or earlier places have left over is used by later ones.
    """
    done = 0
    while done < many:
        used, later, taken = 0, sum(sizes), []
        for s in sizes:
            later -= s
            at = bisect_right(lengths, bins.capacity - used - later) - 1
            while at >= 0 and left[lengths[at]] <= taken.count(lengths[at]):
                at -= 1
            if at < 0:
                return done
            taken.append(lengths[at])
            used += lengths[at]
        block = min([many - done, *(left[n] // taken.count(n) for n in set(taken))])
        bins.add(tuple(taken), block)
        for n in set(taken):
            left[n] -= block * taken.count(n)
            if not left[n]:
                del left[n]
                lengths.remove(n)
        done += block
    return done


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, by_method: list[int] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for so many pieces of each length. by_method receives how many sequences configurations gave."""
    bins, left = _Bins(capacity), dict(counts)
    bins.add((capacity,), left.pop(capacity, 0))
    large = {n: left.pop(n) for n in sorted(left) if n >= capacity * SMALL}
    made = 0
    if large:
        sizes, demand = _grouped(large, groups)
        found = _configurations(sizes, demand, capacity)
        lengths = sorted(large)
        for config, amount in sorted(found, key=lambda f: -f[1]):
            places = [s for s, k in zip(sizes, config, strict=True) for _ in range(k)]
            made += _substituted(bins, places, int(amount + 1e-6), large, lengths)
        left |= large
    for n in sorted(left, reverse=True):
        bins.best_fit(n, left[n])
    if by_method is not None:
        by_method.append(made)
    return bins.all()


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), ordered by length and rank."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, many in pack_lengths(counts, capacity, groups):
        offset = 0
        for n in lengths:
            rows.append((n, used[n], many, sequence, offset))
            used[n] += many
            offset += n
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds (sequence_id, offset) to pieces that have a length. The pieces must be a written table: they are read twice."""
    sizes = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    steps = plan(sizes, capacity, groups)
    salts = max(1, -(-sum(sizes.values()) // SALT_ROWS))
    salted = parts.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {salts}) as int)"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside)).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_rank") - 1)
    names = parts.columns
    key = (steps[:, 0] << 40) + steps[:, 1]
    found = [f for f in parts.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy()
            at = np.searchsorted(key, (b.column("length").to_numpy() << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(shared.tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, groups: int = GROUPS, memo: int = tokens.MEMO) -> DataFrame:
    """Cuts and packs documents: a row per piece with its sequence and its place there. A smaller memo of the encoder takes less memory and more time."""
    return pack(shared.written(pieces(docs, tokenizer, end_id, capacity, memo=memo), "pieces"), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from packed pieces that carry their ids: (sequence_id, ids, doc_ids, lengths)."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(held.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
