"""Vector codes: product quantisation by a delta-maintained Lloyd iteration in whole numbers.

A component x counts as floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts, each with a codebook of its own that
starts from the vectors with the ENTRIES smallest ids. The state of a round is a written table of the
vectors with the assignments of the last two rounds. A round assigns every part to the nearest entry of its
codebook (exactly, ties to the lower index), and only parts whose assignment changed send something:
plus to the new entry's sums and count, minus to the old one's, added up in each task before they are
shuffled. The driver holds the codebooks, running sums and counts (PARTS * ENTRIES entries, whatever the
number of vectors) and divides by floor. Entries without parts stay. A round that
changes no assignment is a fixed point, and the rounds left are skipped as they would change nothing.
A state is one sequential read and one write of small integers, never a shuffle; the state before
goes once the next one stands, so two exist at a time, and a lost executor loses none of them.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors that can't be
cut like the others (another length than most rows have, ties to the shorter; a length that is no
multiple of PARTS; components of 2**28 or more after scaling, whose squares overflow) are kept with
null code and error, and take no part. A null id is coded and seeds nothing; of rows that share an id
the smallest vector seeds, and each is coded. With fewer ids than ENTRIES the codebooks are smaller.
Null labels are one label. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 28
#: Vectors whose distances to a codebook are in memory at once.
BLOCK = 4096
_STATE = "vec_id long, label int, v array<int>, before binary, code binary"


def _rows(column, width: int) -> np.ndarray:
    """Lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, usable) of the kept rows: v in whole numbers, usable if its size can be coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            x = x[: sizes.sum()]
            row = np.repeat(np.arange(len(sizes)), sizes)
            kept = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) == 0)
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(SCALE * x)
            wide = np.bincount(row[~(np.abs(y) < LIMIT)], minlength=len(sizes)) > 0
            usable = kept & ~wide & (sizes > 0) & (sizes % PARTS == 0)
            y = np.where(usable[row], np.nan_to_num(y, nan=0.0, posinf=0.0, neginf=0.0), 0).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(y))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), v, pa.array(usable)], ["vec_id", "label", "v", "usable"]).filter(pa.array(kept))

    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as int) label", "cast(embedding as array<double>) embedding")
    return rows.mapInArrow(shared.tidy(run), "vec_id long, label int, v array<int>, usable boolean")


def seeds(rows: DataFrame) -> list[list[int]]:
    """The vectors of the ENTRIES smallest ids, ascending; no task passes on more rows than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for i in np.argsort(ids, kind="stable"):
                at = int(ids[i])
                if len(least) == ENTRIES and at > max(least):
                    break
                v = batch.column("v")[int(i)].as_py()
                least[at] = min(least.get(at, v), v)
                if len(least) > ENTRIES:
                    del least[max(least)]
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(least.keys(), pa.int64()), "v": pa.array(least.values(), pa.list_(pa.int32()))})

    top = rows.filter("vec_id is not null").select("vec_id", "v").mapInArrow(shared.tidy(run), "vec_id long, v array<int>")
    return [r["v"] for r in top.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(ENTRIES).collect()]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, exactly; ties to the lower index."""
    reach = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    # 4 * width * reach**2 bounds every value on the way: up to 2**53 doubles are exact, beyond that 64-bit integers are
    kind = np.float64 if 4 * x.shape[1] * reach**2 < 2**53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    d = (book * book).sum(1) - 2 * (x @ book.T)
    at = d.argmin(1)
    return at, (d[np.arange(len(x)), at] + (x * x).sum(1)).astype(np.int64)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The state of the next round."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _rows(part.column("v"), PARTS * width)
                codes = np.stack([nearest(x[:, p * width : (p + 1) * width], books[p])[0] for p in range(PARTS)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("v"), part.column("code"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "label", "v", "before", "code"])

    return state.mapInArrow(shared.tidy(run), _STATE)


def changes(state: DataFrame, width: int) -> DataFrame:
    """(slot, delta): what parts with another assignment than before add to the count and the sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta = np.zeros((PARTS, ENTRIES, 1 + width), np.int64)  # bounded by the codebooks
        for batch in batches:
            x = _rows(batch.column("v"), PARTS * width).astype(np.int64)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            known = batch.column("before").is_valid().to_numpy(zero_copy_only=False)
            old = np.frombuffer(b"".join(c or bytes(PARTS) for c in batch.column("before").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                moved = ~known | (old[:, p] != new[:, p])
                part = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]], 1)
                np.add.at(delta[p], new[moved, p], part[moved])
                np.subtract.at(delta[p], old[moved & known, p], part[moved & known])
        flat = delta.ravel()
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "delta": pa.array(flat[slot])})

    moved = state.filter("before is null or before <> code").select("v", "before", "code")
    return moved.mapInArrow(shared.tidy(run), "slot long, delta long").groupBy("slot").agg(F.sum("delta").alias("delta"))


def codebooks(start: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(the last state, the codebooks after all rounds). start: a written table (vec_id, label, v)."""
    width = books.shape[2]
    state = start.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("code"))
    running = np.zeros((PARTS, ENTRIES, 1 + width), np.int64)
    path = None
    for _ in range(rounds):
        state, path, old = *shared.written_at(assigned(state, books), "codes"), path
        shared.forget(old)
        found = changes(state, width).toArrow()
        if not found.num_rows and state.filter("before is null or before <> code").isEmpty():
            break
        running.ravel()[found["slot"].to_numpy()] += found["delta"].to_numpy()
        n = running[:, : books.shape[1], :1]
        books = np.where(n > 0, running[:, : books.shape[1], 1:] // np.maximum(n, 1), books)
    return state, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the kept rows of (vec_id, embedding, label)."""
    rows = shared.written(whole_numbers(vectors), "vectors")
    common = rows.filter("usable").groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = common["size"] if common else PARTS
    fits = F.col("usable") & (F.size("v") == size)
    start = rows.filter(fits).select("vec_id", "label", "v")
    books = np.array(seeds(start), np.int64).reshape(-1, PARTS, size // PARTS).transpose(1, 0, 2)
    if not books.shape[1]:  # nothing seeds
        fits, start = F.lit(False), start.limit(0)
        coded = start.selectExpr("vec_id", "label", "'' code", "0L error")
    else:
        state, books = codebooks(start, books, rounds)
        coded = _coded(state, books)
    rest = rows.filter(~fits).selectExpr("vec_id", "label", "cast(null as string) code", "cast(null as long) error")
    every = shared.written(coded.unionByName(rest), "coded")
    totals = shared.written(every.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    out = every.join(shared.bounded(totals), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) by these codebooks."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _rows(part.column("v"), PARTS * width)
                found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(PARTS)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "label": part.column("label"), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(sum(f[1] for f in found))})

    return state.select("vec_id", "label", "v").mapInArrow(shared.tidy(run), "vec_id long, label int, code string, error long")
