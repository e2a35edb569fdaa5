"""N-gram Jaccard join by size-aware heavy-light signatures.

A document's set holds its distinct shingles of WORDS words (a shorter text: all its words as one;
no words: empty). Two documents link when 100 * |A and B| >= 80 * |A or B|, which is the same as
9 * |A and B| >= 4 * (|A| + |B|).

Light: for two small sets the least overlap of a link follows from their sizes, so each small set
enumerates its subsets of that fixed size; sets that share a subset are linked for certain.
Heavy: a larger set enters the inverted lists of its rarest shingles, as many as must hold one of
any partner's. The order of rarity comes from a fixed-size count sketch over all documents; any
order gives the same links. The boundary between the two is the one of least estimated cost, from
the counts of sets of each size.

Sets that are equal are one class, represented by its smallest doc_id; only representatives go on.
In a short list the pairs are counted, and only those stay that share as many prefix keys as a link
between sets of their sizes must. The documents of a longer list, and of such pairs, form a family,
named by the smallest of them, or by that of a family with a smaller name which one of them stands
in too. A family's documents are
compared in blocks: a large family's blocks are written once and compared in pairs, each a task's work,
and only each document's count of links and a spanning forest of the links come back, never the pairs. Components
are then found by star contraction over written tables.

Null and empty texts have empty sets, no links, and a component of their own. Repeated rows: a row
each; they are copies of one another. Rows that share a doc_id but not the text stand each for its
own text: where a doc_id has several sets, a set goes by a hash of its doc_id and itself. Null
doc_id: the row stays, linked with nothing, its component null. Ties: the smallest doc_id names a
component. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import shared

WORDS = 5
U = np.uint64
#: Counters of the sketch, as a power of two, and counters of one of its rows.
SKETCH_BITS, SKETCH_CHUNK = 22, 4096
#: Bits of the bitmaps that spare work on documents that cannot matter (joins decide exactly).
FILTER_BITS = 26
#: Sets of a block at most, by expectation, and shingles of a block; a family is cut into FEW blocks if each has LEAST_SETS.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
FEW, LEAST_SETS = 8, 256
#: Tasks at most over which the pairs of blocks are dealt.
MOST_TASKS = 4096
#: Documents of a list up to which its pairs are counted one by one; longer lists make families at once.
SHORT_LIST = 8
#: No boundary beyond this size is tried: a set of 16 has some thousand subsets.
LARGEST_LIGHT = 16
#: Cost of comparing one shingle, in signatures.
COMPARE = 0.25


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all texts end to end, and where each begins."""
    words = K.Words(data, offsets)
    h = words.hashes()
    grams = K.windows(h, WORDS)
    n = np.diff(words.ptr)
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    ptr = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(ptr[-1], U)
    for a, k, at, end in zip(words.ptr.tolist(), n.tolist(), ptr.tolist(), ptr[1:].tolist(), strict=False):
        if k >= WORDS:
            own = flat[at:end]
            own[:] = grams[a : a + k - WORDS + 1]
            own.sort()
        elif k:
            flat[at] = K.windows(h[a : a + k], k)[0]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[ptr[:-1][size > 0]] = True
    return flat[fresh], np.concatenate([[0], np.cumsum(fresh)])[ptr]


def _bits(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers."""
    return x.view(np.int64)


def _sums(flat: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    total = np.zeros((2, len(flat) + 1), U)
    for k, seed in enumerate((0x5BD1E995C3A5C85C, 0x2545F4914F6CDD1D)):
        np.cumsum(K.mix(flat ^ U(seed)), out=total[k, 1:])
    return total[0, ptr[1:]] - total[0, ptr[:-1]], total[1, ptr[1:]] - total[1, ptr[:-1]]


def _nodes(ids: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """What a set goes by where its doc_id has several."""
    return _bits(K.mix(K.mix(K.mix(ids.view(U) + U(0x9FB21C651E98DF25)) + s1) + s2))


def summarised(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, s1, s2, slot, own), and per task the chunks (chunk, counts) of its sketch."""
    names = ["doc_id", "n", "s1", "s2", "slot", "own", "chunk", "counts"]
    schema = "doc_id long, n long, s1 long, s2 long, slot long, own long, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                flat, ptr = shingle_sets(data, offsets)
                np.add.at(sketch, (flat >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
                n, rows = np.diff(ptr), len(ptr) - 1
                s1, s2 = _sums(flat, ptr)
                ids = batch.column("doc_id").slice(at, rows)
                plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
                slot = K.id_slots(plain, FILTER_BITS)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(_bits(s1)), pa.array(_bits(s2)), pa.array(slot), pa.array(_nodes(plain, s1, s2)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if sketch.any():
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, SKETCH_CHUNK)
            used = np.flatnonzero(parts.any(axis=1))
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, none, pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(shared.tidy(run), schema)


def sketch_classes(summary: DataFrame) -> np.ndarray:
    """Quarter powers of two of each counter's sum over all tasks; of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(counts, np.uint8).astype(np.int64)
                total[chunk] = total[chunk] + part if chunk in total else part
        for chunk, part in total.items():
            levels = np.round(4 * np.log2(part + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([levels.tobytes()], pa.binary())})

    parts = summary.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(shared.tidy(add), "chunk int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK, np.uint8)[:, None].repeat(SKETCH_CHUNK, axis=1)
    for row in parts.collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def least_overlap(a: int, b: int) -> int:
    return (4 * (a + b) + 8) // 9


def prefix_length(n: int) -> int:
    """So many first shingles of a set hold one that any linked set also has among its own."""
    return n - (4 * n + 4) // 5 + 1


def partners(n: int, boundary: int) -> list[int]:
    """The sizes up to the boundary with which a set of this size can link."""
    return [m for m in range((4 * n + 4) // 5, min(boundary, 5 * n // 4) + 1) if m]


def choose_boundary(sizes: dict[int, int]) -> int:
    """The size up to which sets are light, of least estimated cost for so many sets of each size."""

    def cost(boundary: int) -> float:
        light = sum(c * sum(comb(n, least_overlap(n, m)) for m in partners(n, boundary)) for n, c in sizes.items() if 0 < n <= boundary)
        return light + sum(c * (prefix_length(n) + COMPARE * n) for n, c in sizes.items() if 5 * n >= 4 * (boundary + 1))

    return min(range(LARGEST_LIGHT + 1), key=cost)


@cache
def _subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def signatures(flat: np.ndarray, ptr: np.ndarray, classes: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row): the keys under which each set meets every set it links with."""
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), n)
    keys, rows = [], []
    for i in np.flatnonzero((n > 0) & (n <= boundary)):
        size = int(n[i])
        spread = K.mix(flat[ptr[i] : ptr[i + 1]] ^ U(0x9FB21C651E98DF25))
        for m in partners(size, boundary):
            lo, hi = min(size, m), max(size, m)
            keys.append(K.mix(spread[_subsets(size, least_overlap(size, m))].sum(axis=1, dtype=U) + U(lo * 1000 + hi)))
            rows.append(np.full(len(keys[-1]), i))
    heavy = (n > 0) & (5 * n >= 4 * (boundary + 1))
    # sets are sorted, so a stable sort by row and rarity leaves ties in order of their hashes
    order = np.argsort(row * 256 + classes[(flat >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    place = np.arange(len(flat)) - ptr[:-1][row]
    use = heavy[row] & (place < (n - (4 * n + 4) // 5 + 1)[row])
    return np.concatenate([*keys, flat[order[use]]]), np.concatenate([*rows, row[use]]).astype(np.int64)


def compare_block(pivot: int, same: bool, ids: np.ndarray, left: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, families: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here, root) of each document of a pair of blocks.

    A pair that several families hold is counted in the one with the smallest name. The root is the
    smallest document that links within these blocks reach.
    """
    n = np.array([len(x) for x in sets])
    a = np.flatnonzero(left)
    b = a if same else np.flatnonzero(~left)
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    if not len(a) or not len(b):
        return links, root
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_code = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), n)
    keep = count[code] > 1
    owner, code = owner[keep], shared_code[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    overlap = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):  # the inverted lists of some shingles at a time
        lo, hi = np.searchsorted(code, [at, at + width])
        lists = np.zeros((len(sets), min(width, int(code[-1]) + 1 - at)), np.float32)
        lists[owner[lo:hi], code[lo:hi] - at] = 1
        overlap += lists[a] @ lists[b].T
    linked = (9 * overlap >= 4 * (n[a][:, None] + n[b][None, :])) & (n[a] > 0)[:, None]
    if same:
        np.fill_diagonal(linked, False)
    linked &= ids[a][:, None] != ids[b][None, :]
    smaller = sorted({f for fs in families for f in fs if f < pivot})
    if smaller:
        place = {f: k for k, f in enumerate(smaller)}
        member = np.zeros((len(ids), len(smaller)), np.float32)
        for i, fs in enumerate(families):
            member[i, [place[f] for f in fs if f < pivot]] = 1
        linked &= member[a] @ member[b].T == 0
    links[a] = linked @ weight[b]
    if not same:
        links[b] = weight[a] @ linked
    before = None
    while before is None or (root != before).any():
        before = root.copy()
        big = np.int64(2**63 - 1)
        root[a] = np.minimum(root[a], np.where(linked, root[b][None, :], big).min(axis=1))
        root[b] = np.minimum(root[b], np.where(linked, root[a][:, None], big).min(axis=0))
    return links, root


def _links(key: tuple[int, int, int], held: list[tuple]) -> pa.RecordBatch:
    """(doc_id, links, root) of the rows (b, member, weight, families, x) of the blocks i and j of a family, key: (pivot, i, j)."""
    held = list({(r[1], r[4]): r for r in held}.values())  # repeated rows of a document
    held.sort(key=lambda r: (r[1], r[4]))
    ids = np.array([r[1] for r in held], np.int64)
    sets = [np.frombuffer(r[4], U) for r in held]
    links, root = compare_block(key[0], key[1] == key[2], ids, np.array([r[0] == key[1] for r in held]), sets, np.array([r[2] for r in held], np.int64), [r[3] for r in held])
    use = (links > 0) | (root != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use]), pa.array(root[use])], ["doc_id", "links", "root"])


_HELD = ["b", "member", "weight", "families", "x"]


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in _HELD), strict=True))


def _compared(rows: DataFrame) -> DataFrame:
    """(doc_id, links, root) from rows (pivot, b, g, member, weight, families, x).

    A family of one block is compared where its rows meet. The blocks of a larger one are written once, a
    file each, and every pair of blocks reads its two: sets are shuffled once, however many pairs there are.
    """
    folder = shared.new_folder(rows.sparkSession, "blocks")
    schema = "doc_id long, links long, root long, pivot long, b int, path string"

    def finish(key: tuple[int, int, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        pivot, b, g = key
        if g == 1:
            out = _links((pivot, 0, 0), [r for batch in held for r in _rows(batch)])
            none = pa.nulls(out.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([*out.columns, none, none.cast(pa.int32()), none.cast(pa.string())], ["doc_id", "links", "root", "pivot", "b", "path"])

        def put(out) -> None:
            with pa.ipc.new_file(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as sink:
                for batch in held:
                    sink.write_batch(batch)

        path = shared.publish(folder, f"{pivot}-{b}.arrow", put)
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array([pivot]), pa.array([b], pa.int32()), pa.array([path])], ["doc_id", "links", "root", "pivot", "b", "path"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("pivot", "b", "g")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if key != (now := tuple(int(c[lo]) for c in cols)):
                    if held:
                        yield finish(key, held)
                    key, held = now, []
                held.append(batch.slice(lo, hi - lo).select(_HELD))
        if held:
            yield finish(key, held)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[tuple] = []
                for path in dict.fromkeys((row["one"], row["two"])):
                    store, at = shared.filesystem(path)
                    with store.open_input_file(at) as f, pa.ipc.open_file(f) as file:
                        for k in range(file.num_record_batches):
                            held += _rows(file.get_batch(k))
                yield _links((row["pivot"], row["i"], row["j"]), held)

    met = shared.written(rows.repartition("pivot", "b").sortWithinPartitions("pivot", "b").mapInArrow(shared.tidy(meet), schema), "blocks")
    files = met.filter("path is not null")
    pairs = files.selectExpr("pivot", "b i", "path one").join(files.selectExpr("pivot", "b j", "path two"), "pivot").filter("i <= j")
    pairs = shared.written(pairs, "pairs")
    found, n = met.filter("path is null").select("doc_id", "links", "root"), pairs.count()
    if not n:
        return found
    pairs = pairs.repartition(min(n, MOST_TASKS), "pivot", "i", "j")  # a number, as small rows would be gathered in one task
    found = shared.written(found.unionByName(pairs.mapInArrow(shared.tidy(pair), "doc_id long, links long, root long")), "links")
    shared.forget(folder)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of the ends of edges (u, v), by large and small stars; each round is a written table."""
    edges = shared.written(edges.selectExpr("greatest(u, v) u", "least(u, v) v").filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").filter("v > u").selectExpr("v u", "m v").filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END u", "m v").filter("u <> v").distinct()
        edges = shared.written(small, "edges")
        now = tuple(edges.selectExpr("count(*) n", "bit_xor(xxhash64(u, v)) x").first())
        if now == state:
            return edges.selectExpr("u doc_id", "v component").unionByName(edges.selectExpr("v doc_id", "v component").distinct())
        state = now


def _linked(docs: DataFrame) -> DataFrame:
    """The rows of link(), each with a hash of its set, and a name for its component that no other one has."""
    docs = docs.select("doc_id", "text")
    summary = shared.written(summarised(docs), "sets")
    classes = sketch_classes(summary)
    rows = summary.filter("chunk is null").select("doc_id", "n", "s1", "s2")
    full = summary.filter("chunk is null and doc_id is not null and n > 0")
    several = shared.written(full.groupBy("doc_id").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.first("slot").alias("slot")).filter("lo < hi").select("slot").distinct(), "several")
    many = None if several.isEmpty() else shared.bitmap(several, FILTER_BITS)
    groups = full.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "slot", "own")).alias("r"), F.count("*").alias("copies"))
    reps = groups.selectExpr("n", "s1", "s2", "r.doc_id rep", "r.slot slot", "r.own own", "copies")
    if many is not None:
        reps = reps.join(shared.bounded(several.withColumn("many", F.lit(True))), "slot", "left")
    reps = reps.withColumn("node", F.expr("CASE WHEN many THEN own ELSE rep END" if many is not None else "rep"))
    reps = shared.written(reps.select("n", "s1", "s2", "rep", "slot", "copies", "node"), "classes")
    sizes = reps.groupBy(F.least("n", F.lit(2 * LARGEST_LIGHT)).alias("n")).count()
    boundary = choose_boundary({int(r["n"]): int(r["count"]) for r in sizes.collect()})
    wanted = shared.bitmap(reps, FILTER_BITS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, flat, ptr in _wanted(batch, wanted, many):
                found, row = signatures(flat, ptr, classes, boundary)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(len(ptr))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(at), pa.array(_bits(found[order])))], ["doc_id", "keys"])

    # lists are counted and their members told after one shuffle of the keys
    entries = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(shared.tidy(keys), "doc_id long, keys array<long>").selectExpr("doc_id", "explode(keys) key")
    same = Window.partitionBy("key")
    lists = entries.select("doc_id", "key", F.min("doc_id").over(same).alias("pivot"), F.max("doc_id").over(same).alias("last"), F.count("*").over(same).alias("c")).filter("pivot < last").drop("last")
    known = reps.selectExpr("node member", "copies weight", "n", "slot")
    met = shared.written(lists.withColumnRenamed("doc_id", "member").join(known.select("member", "n"), "member"), "lists")
    long = met.filter(f"c > {SHORT_LIST}").select("pivot", "member").distinct()
    # a short list's pairs are counted: two documents that share no long list share all their common
    # prefix keys here, and beyond the prefix that ends first a link has no more than its size allows
    short = met.filter(f"c <= {SHORT_LIST}").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("member", "n"))).alias("m"))
    pairs = short.selectExpr("explode(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> named_struct('a', x.member, 'b', y.member, 'an', x.n, 'bn', y.n))))) p").select("p.*")
    pairs = pairs.filter("a <> b and 5 * least(an, bn) >= 4 * greatest(an, bn)").groupBy("a", "b", "an", "bn").agg(F.count("*").alias("c"))
    pairs = pairs.filter(f"greatest(an, bn) <= {boundary} or c >= ceil(4 * (an + bn) / 9) - ceil(4 * greatest(an, bn) / 5) + 1")
    close = pairs.selectExpr("a pivot", "explode(array(a, b)) member")
    met = shared.written(long.unionByName(close).distinct().join(known, "member"), "families")
    # families that meet in a document with a smaller family take its name: near copies then stand in one family, not in one for each smallest document of a list
    least = met.groupBy("member").agg(F.min("pivot").alias("least"))
    names = met.join(least, "member").groupBy("pivot").agg(F.min("least").alias("name"))
    met = met.join(names, "pivot").drop("pivot").withColumnRenamed("name", "pivot").distinct()
    met = shared.written(met.select("pivot", "member", "weight", "n", "slot"), "families")
    kept = met.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    # two documents whose sizes lie too far apart cannot link
    kept = kept.filter("c > 2 or c = 2 and 5 * lo >= 4 * hi").selectExpr("pivot", f"cast(greatest(ceil(c / {BLOCK_SETS}), least({FEW}, ceil(c / {LEAST_SETS})), ceil(total / {BLOCK_SHINGLES})) as int) g")
    met = shared.written(met.join(kept, "pivot"), "families")
    place = met.join(met.groupBy("member").agg(F.array_sort(F.collect_list("pivot")).alias("families")), "member")
    needed = shared.bitmap(met.select("slot"), FILTER_BITS)

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, flat, ptr in _wanted(batch, needed, many):
                x = pa.Array.from_buffers(pa.large_binary(), len(nodes), [None, pa.py_buffer((8 * ptr).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), x], ["member", "x"])

    own = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(shared.tidy(full_sets), "member long, x binary")
    blocks = place.join(own, "member").selectExpr("pivot", "cast(pmod(xxhash64(member), g) as int) b", "g", "member", "weight", "families", "x")
    compared = _compared(blocks)
    found = components(compared.filter("root <> doc_id").selectExpr("doc_id u", "root v"))
    counts = compared.groupBy("doc_id").agg(F.sum("links").alias("links"))
    found, counts = found.withColumnRenamed("doc_id", "node").withColumnRenamed("component", "group"), counts.withColumnRenamed("doc_id", "node")
    if many is None:
        found = found.withColumn("component", F.col("group"))
    else:  # the smallest node need not be the smallest doc_id
        least = found.join(reps, "node").groupBy("group").agg(F.min("rep").alias("component"))
        found = found.join(least, "group")
    reps = reps.join(found, "node", "left").join(counts, "node", "left").withColumn("group", F.coalesce("group", "node")).drop("slot", "node")
    own_row = "doc_id is null or n = 0"
    return rows.join(reps, ["n", "s1", "s2"], "left").selectExpr(
        "doc_id", "n n_shingles",
        f"CASE WHEN {own_row} THEN doc_id ELSE coalesce(component, rep) END component_id",
        f"CASE WHEN {own_row} THEN doc_id ELSE rep END class_id",
        f"CASE WHEN {own_row} THEN 1L ELSE copies END n_copies",
        f"CASE WHEN {own_row} THEN 0L ELSE coalesce(links, 0L) + copies - 1 END n_links",
        "s1", f"CASE WHEN {own_row} THEN null ELSE `group` END group",
    )


def link(docs: DataFrame) -> DataFrame:
    """A row per document of (doc_id, text): n_shingles, component_id, class_id, n_copies and n_links."""
    return _linked(docs).drop("s1", "group")


def _wanted(batch: pa.RecordBatch, bitmap: np.ndarray, many: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sets end to end, where each begins) of slices of the batch's rows that the bitmap lets pass; rows without an id don't."""
    slots = K.id_slots(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), FILTER_BITS)
    ok = shared.in_bitmap(bitmap, slots) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    batch, slots = batch.filter(pa.array(ok)), slots[ok]
    hashed = shared.in_bitmap(many, slots) if many is not None else np.zeros(len(slots), bool)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for at, data, offsets in K.slices(batch.column("text")):
        rows = slice(at, at + len(offsets) - 1)
        flat, ptr = shingle_sets(data, offsets)
        nodes, own = ids[rows].astype(np.int64), hashed[rows]
        if own.any():
            s1, s2 = _sums(flat, ptr)
            nodes[own] = _nodes(nodes[own], s1[own], s2[own])
        yield nodes, flat, ptr


def _with_sets(docs: DataFrame, size: str, of: str) -> DataFrame:
    """The documents with the size of each text's set, and the hash that _linked gives as s1."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                flat, ptr = shingle_sets(data, offsets)
                part = batch.slice(at, len(ptr) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(ptr)), pa.array(_bits(_sums(flat, ptr)[0]))], [*part.schema.names, size, of])

    return docs.mapInArrow(shared.tidy(run), f"{fields}, `{size}` long, `{of}` long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents themselves, with one row of each component: that of its smallest doc_id (of several texts of that id, the one with the smallest hash).

    Rows without an id stay, and so do rows without words, which are linked with nothing.
    """
    found = shared.written(_linked(docs).select("doc_id", "n_shingles", "component_id", "s1", "group"), "components").filter("doc_id is not null")
    own, size, of = (shared.fresh(docs, c) for c in ("_id", "_size", "_set"))
    ids = found.groupBy(F.col("doc_id").alias(own)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"), F.count("*").alias("c"))
    ids = shared.written(ids.filter("not names or c > 1"), "duplicates")
    same = F.col("doc_id") == F.col(own)
    rest = docs.join(shared.bounded(ids.select(own)), same, "left_anti")
    # rows that share an id are told apart by their sets
    kept = found.filter("n_shingles > 0 and doc_id = component_id").join(ids.filter("c > 1").select(own), same, "left_semi")
    kept = kept.groupBy("doc_id", "group").agg(F.min("s1").alias(of)).select(F.col("doc_id").alias(own), of).distinct()
    several = shared.written(_with_sets(docs.join(shared.bounded(ids.filter("c > 1").select(own)), same, "left_semi"), size, of), "several")
    again = several.join(shared.bounded(shared.written(kept, "kept")).withColumnRenamed(of, f"{of}_"), same & (F.col(of) == F.col(f"{of}_")), "left_semi").filter(f"`{size}` > 0")
    again = again.dropDuplicates(["doc_id", of]).unionByName(several.filter(f"`{size}` = 0")).drop(size, of)
    return rest.unionByName(again)
