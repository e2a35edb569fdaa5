"""Token ids of whole texts, and token files in the Arrow file format.

An Encoder gives exactly the ids of the tokenizers library for the whole text. Words recur, so it
keeps a bounded memo of pieces that the tokenizer can never join with their neighbours: runs up to
white space, and below those the matches of the tokenizer's own split pattern. Pieces outside
Latin-1, or that could hold a special token, go through the library's full pipeline; a tokenizer of
another kind than the two known here always does.

A token file holds sequences of one fixed length as fixed-size lists of ids with fixed-size lists
of mask bytes beside them, uncompressed, so that any sequence of any batch and its mask can be read
from a memory map without a copy. A file has two different masks at most, so they are dictionary-encoded. Documents lie end to end in ascending doc_id; only the last sequence of a file
is padded (mask false). A second Arrow file beside it gives each document's place.

Null text: as an empty text, so the end id alone. Null doc_id: kept, before all others. Repeated
rows and tied ids: each row is a document; ties stand in the order of a hash of their text and may be dealt
to several parts, rows that are equal in both stand together. Other columns are ignored. An
empty table writes no files and gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Entries of each generation of a worker process's memos.
MEMO = 1 << 18
#: Characters that Python and the library may disagree on as white space: such texts go to the library whole.
_ODD = "\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"
#: White space of Latin-1 other than space and line feed.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_PLAIN = re.compile(r"(?:[\t-\r -;=-~\xa1-\xff]|<(?!\|))*")
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_CHUNKS = re.compile(r"\s*\S+|\s+")
_TAIL = re.compile(r"\s+\Z")


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class _Memo(dict):
    """Two generations of at most `limit` entries: what is still in use when one fills moves on to the next."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _single_spaced(text: str) -> bool:
    """Latin-1 whose words stand one space or line feeds apart, and that begins and ends with a word."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return text[0] != " " and not text[-1].isspace() and "  " not in text and "\n " not in text and not any(c in text for c in _RARE)


class Encoder:
    """Little-endian ids of texts, 2 or 4 bytes each."""

    def __init__(self, path: str, width: int = 4, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.code = self.whole.model, {2: "H", 4: "I"}[width]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in before.get("pretokenizers", [])]
        tidy = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.kind = ""
        if spec["model"]["type"] == "BPE" and steps == ["Split", "ByteLevel"] and tidy == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        elif spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "byte"
        self.pieces = _Memo(self._piece, memo)
        self.chunks = _Memo(self._chunk, memo)
        self.spaced = _Memo(lambda part: self._chunk(" " + part), memo)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _all(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))])

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self._all(chunk)
        if self.kind == "word":
            return b"".join(map(self.pieces.__getitem__, _WORD_PIECES.findall(chunk.lower())))
        return b"".join(map(self.pieces.__getitem__, _BYTE_PIECES.findall(chunk)))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "byte" and _single_spaced(text):
            first, *rest = text.split(" ")
            return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))
        if not self.kind or any(c in text for c in _ODD):
            return self._all(text)
        if self.kind == "word":
            return b"".join(map(self.chunks.__getitem__, text.split()))
        tail = _TAIL.search(text)
        parts = _CHUNKS.findall(text[: tail.start()] if tail else text)
        return b"".join(map(self.chunks.__getitem__, parts)) + (self._all(tail[0]) if tail else b"")


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, width: int = 4, memo: int = MEMO) -> Encoder:
    """The worker process's encoder of this vocabulary."""
    if (path, width, memo) not in _ENCODERS:
        _ENCODERS[path, width, memo] = Encoder(path, width, memo)
    return _ENCODERS[path, width, memo]


def crc32(ids: np.ndarray | bytes) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, (bytes, memoryview)) else ids.astype("<u4").tobytes())


# --- token files ---------------------------------------------------------------------------------

#: Ids of a sequence, and sequences of a record batch.
SEQUENCE, BATCH = 1024, 256
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, sequence: int = SEQUENCE, batch: int = BATCH) -> list[dict]:
    """Writes the documents in ascending doc_id; gives a row per file (part, path, n_docs, n_tokens), in order.

    One range shuffle of the texts, so that parts follow one another. Rows that share an id are ordered
    by a hash of their text, so a repeated task sends each row where it went before, whatever the order
    it reads them in. Each task writes its own files
    under a name of their own and renames them, so lost and repeated tasks do no harm.
    """
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id)
    width, kind = (2, pa.uint16()) if top < 1 << 16 else (4, pa.uint32())
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), sequence)))], {"end_id": str(end_id), "sequence": str(sequence), "batch": str(batch)})
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, width)
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        full = sequence * batch * width

        def put(out) -> None:
            held = bytearray()
            with pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)) as sink:

                def flush(upto: int) -> None:
                    ids = np.frombuffer(bytes(held[:upto]), f"<u{width}")
                    rows, over = divmod(len(ids), sequence)
                    masks, which = np.ones(sequence * (1 + (over > 0)), np.uint8), np.zeros(rows + (over > 0), np.int8)
                    if over:  # the last sequence of the file
                        masks[sequence + over :], which[-1] = 0, 1
                        ids = np.concatenate([ids, np.zeros(sequence - over, ids.dtype)])
                    mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks), sequence))
                    sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), sequence), mask], schema=schema))
                    del held[:upto]

                for b in batches:
                    doc_ids.extend(b.column("doc_id").to_pylist())
                    for value in b.column("text"):
                        ids = encode(value.as_py() or "") + end
                        sizes.append(len(ids) // width)
                        held += ids
                        while len(held) >= full:
                            flush(full)
                if held:
                    flush(len(held))

        first = next(batches, None)
        if first is None:
            return
        given, batches = batches, iter([first])
        batches = (b for group in ([first], given) for b in group)
        path = shared.publish(folder, f"part-{part:06d}.arrow", put)
        if not doc_ids:
            return
        index = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})

        def put_index(out) -> None:
            with pa.ipc.new_file(out, index.schema) as sink:
                sink.write_table(index)

        shared.publish(folder, f"part-{part:06d}.index.arrow", put_index)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [sum(sizes)]})

    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return sorted((r.asDict() for r in ordered.mapInArrow(shared.tidy(write), MANIFEST).collect()), key=lambda r: r["part"])


class TokenFile:
    """Random access to a token file; a local one is mapped into memory and read without copies."""

    def __init__(self, path: str):
        def opened(p: str):
            store, at = shared.filesystem(p)
            return pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at)

        self.reader = pa.ipc.open_file(opened(path))
        info = {k.decode(): v.decode() for k, v in self.reader.schema.metadata.items()}
        self.sequence, self.per_batch = int(info["sequence"]), int(info["sequence"]) * int(info["batch"])
        index = pa.ipc.open_file(opened(path.removesuffix(".arrow") + ".index.arrow")).read_all()
        self.doc_ids, self.sizes = index["doc_id"], index["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._at, self._ids = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._ids

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i."""
        b = self.reader.get_batch(i * self.sequence // self.per_batch)
        row = i % (self.per_batch // self.sequence)
        masks = b.column(1).dictionary.values.to_numpy(zero_copy_only=True).reshape(-1, self.sequence)
        return b.column(0)[row].values.to_numpy(zero_copy_only=True), masks[b.column(1).indices[row].as_py()]

    def tokens(self, start: int, end: int) -> np.ndarray:
        parts = []
        while start < end:
            k, at = divmod(start, self.per_batch)
            upto = min(end - start, self.per_batch - at)
            parts.append(self._batch(k)[at : at + upto])
            start += upto
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def filled(self) -> int:
        """How many ids the masks mark."""
        total = 0
        for k in range(self.reader.num_record_batches):
            mask = self.reader.get_batch(k).column(1)
            sizes = mask.dictionary.values.to_numpy(zero_copy_only=True).reshape(-1, self.sequence).sum(axis=1, dtype=np.int64)
            total += int(sizes[mask.indices.to_numpy()].sum())
        return total


def read_token_files(spark, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest in order."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    base = np.concatenate([[0], np.cumsum([m["n_tokens"] for m in manifest])]).tolist()
    rows = [(m["path"], b, m["n_tokens"]) for m, b in zip(manifest, base, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["path"])
                if f.filled() != row["n_tokens"]:
                    raise ValueError(f"{row['path']}: the masks mark {f.filled()} ids; {row['n_tokens']} were written")
                for a in range(0, len(f.sizes), 10_000):
                    part = range(a, min(a + 10_000, len(f.sizes)))
                    crc = [crc32(f.tokens(f.starts[i], f.starts[i + 1])) for i in part]
                    yield pa.RecordBatch.from_pydict({"doc_id": f.doc_ids.slice(a, len(part)).combine_chunks(), "start": f.starts[a : part.stop] + row["base"], "n_tokens": f.sizes[a : part.stop], "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.createDataFrame(rows, "path string, base long, n_tokens long")
    return files.repartition(max(1, len(rows)), F.col("path")).mapInArrow(shared.tidy(read), schema)
