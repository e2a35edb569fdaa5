"""WARC archives: writing pages with revisits and segments, and reading them back.

Writing: of pages with equal payloads of MIN_REVISIT bytes or more, the one with the smallest
page_id becomes a response and the others revisit it. Who revisits whom is settled on digests alone:
responses are written where their pages are read, and revisits, which have no payload, from the table
of digests, so payloads are not shuffled. A fixed-size bitmap tells likely revisits from the rest
during the scan; the few responses that it takes for revisits are found by a join and written after.
Bodies are sent in chunked framing; a block over SEGMENT bytes is cut into a first record and
continuation records. Every record has an id of its own, made from its page, payload, archive and
place among equal rows of that archive, and revisits name the id of a record that was written.

Reading: records of a file are parsed as a stream. Segments are grouped by their origin's record
id, whatever file they are in, ordered by segment number, checked against the total length of the
last one, and joined; chunked framing is then decoded. A repeated segment counts once; a record
with a segment missing, a wrong total, broken framing or another digest than it states, or that the end
of its archive cuts off, is given with complete = false and no payload, and all others are whole.

Null html: an empty payload. Null url: the page is named by its id. Null page_id: always a response
of its own. Repeated rows: each is a record, of any size, and equal rows with the smallest id are all
responses. Other columns are ignored. An empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_REVISIT = 100
#: Bytes of a segment's block, and of a chunk of the body.
SEGMENT, CHUNK = 16_384, 4_096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Bits of the bitmaps of likely revisits, and of pages that revisits may refer to.
FILTER_BITS = 26
_SLOT = f"shiftrightunsigned(xxhash64(page_id, digest), {64 - FILTER_BITS})"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, large, slot) of each row: large ones may revisit, and the slot stands for page and payload."""
    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "sha2(coalesce(html, ''), 256) digest", f"coalesce(page_id is not null and octet_length(html) >= {MIN_REVISIT}, false) large")
    return rows.selectExpr("*", f"{_SLOT} slot")


def originals(rows: DataFrame) -> DataFrame:
    """(digest, refers_to) of payloads that several pages have, from described rows: the smallest page_id."""
    found = rows.filter("large").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"))
    return found.filter("refers_to < _last").drop("_last")


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        n = int(framed[at:line].split(b";")[0], 16)
        if n < 0:
            raise ValueError("a chunk of negative length")
        if n == 0:
            return b"".join(out)
        out.append(framed[line + 2 : line + 2 + n])
        if len(out[-1]) < n or framed[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk is shorter than its length")
        at = line + 4 + n


def payload(block: bytes) -> bytes:
    """The body of an HTTP response, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_NOTHING = {"digest": None, "payload_bytes": None}


def checked(block: bytes, stated: str | None) -> dict:
    """Digest and size of a response's payload; both None if its framing is broken or the digest isn't the stated one."""
    try:
        body = payload(block)
    except ValueError:
        return _NOTHING
    found = hashlib.sha256(body).hexdigest()
    return {"digest": found, "payload_bytes": len(body)} if stated in (None, "", found) else _NOTHING


def record_id(page_id: int | None, digest: str, archive: str, nth: int = 0, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{archive}/{nth}/{segment}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(row: dict, archive: str, nth: int = 0, segment: int = SEGMENT) -> Iterator[bytes]:
    """The gzip members of one page: its record, and continuations if the block is long. A row with `refers` is a revisit."""
    page_id, digest = row["page_id"], row["digest"]
    url = quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~") if row["url"] else f"urn:page:{page_id}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    common += [("Page-Id", str(page_id))] if page_id is not None else []
    own = record_id(page_id, digest, archive, nth)
    if "refers" in row:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers"]), ("Content-Type", "application/http; msgtype=response")], HTTP)
        return
    block = HTTP + chunked((row["html"] or "").encode())
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind], block)
        return
    n = -(-len(block) // segment)
    for k in range(1, n + 1):
        place = [("WARC-Segment-Number", str(k))]
        if k > 1:
            place += [("WARC-Segment-Origin-ID", own)]
        if k == n:
            place += [("WARC-Segment-Total-Length", str(len(block)))]
        yield _record([("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(page_id, digest, archive, nth, k)), *common, *place, *([kind] if k == 1 else [])], block[(k - 1) * segment : k * segment])


MANIFEST = "path string, page_id long, digest string, record_id string"


def _archived(rows: DataFrame, folder: str, name: str, segment: int, skip: np.ndarray | None = None, named: np.ndarray | None = None) -> DataFrame:
    """Writes an archive per task of the rows whose slot is not in skip; gives the paths, and the record ids of the rows whose slot is in named."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if skip is not None:
            batches = (b.filter(pa.array(~shared.in_bitmap(skip, b.column("slot").to_numpy()))) for b in batches)
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        archive, seen, ids = f"{name}-{TaskContext.get().partitionId():06d}", Counter(), []

        def put(out) -> None:
            for batch in itertools.chain([first], batches):
                wanted = shared.in_bitmap(named, batch.column("slot").to_numpy()) if named is not None else np.zeros(batch.num_rows, bool)
                for at in range(0, batch.num_rows, 64):
                    for i, row in enumerate(batch.slice(at, 64).to_pylist(), at):
                        key = (row["page_id"], int(row["digest"][:15], 16))
                        for member in records(row, archive, seen[key], segment):
                            out.write(member)
                        if wanted[i]:
                            ids.append((row["page_id"], row["digest"], record_id(row["page_id"], row["digest"], archive, seen[key])))
                        seen[key] += 1

        path = shared.publish(folder, f"{archive}.warc.gz", put)
        columns = [[path, *[None] * len(ids)], *([None, *(x[k] for x in ids)] for k in range(3))]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "page_id", "digest", "record_id"])

    return shared.written(rows.mapInArrow(shared.tidy(write), MANIFEST), "manifest")


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT) -> list[str]:
    """Writes an archive per task; gives their paths."""
    rows = shared.written(described(pages), "digests")
    first = shared.written(originals(rows), "originals")
    revisits = rows.filter("large").join(shared.bounded(first), "digest").filter("page_id <> refers_to")
    again = shared.bitmap(revisits.select("slot"), FILTER_BITS)
    named = shared.bitmap(first.withColumnRenamed("refers_to", "page_id").selectExpr(f"{_SLOT} slot"), FILTER_BITS)
    payloads = pages.selectExpr("cast(page_id as long) page_id", "url", "html", "sha2(coalesce(html, ''), 256) digest").selectExpr("*", f"{_SLOT} slot")
    done = [_archived(payloads, folder, "response", segment, again, named)]

    def among(words: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(shared.in_bitmap(words, b.column("slot").to_numpy())))

        return run

    # responses that share a revisit's slot
    sure = revisits.select("page_id", "digest").distinct()
    missed = rows.select("page_id", "digest", "slot").mapInArrow(shared.tidy(among(again)), "page_id long, digest string, slot long")
    spared = shared.bitmap(missed.join(sure, ["page_id", "digest"], "left_anti").select("slot"), FILTER_BITS)
    if spared.any():
        late = payloads.mapInArrow(shared.tidy(among(spared)), payloads.schema).join(sure, ["page_id", "digest"], "left_anti")
        done.append(_archived(late.select(*payloads.columns), folder, "spared", segment, None, named))
    ids = functools.reduce(DataFrame.unionByName, done).filter("record_id is not null")
    ids = ids.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min("record_id").alias("refers"))
    target = shared.written(first.join(ids, ["refers_to", "digest"]).select("digest", "refers_to", "refers"), "targets")
    later = rows.filter("large").join(shared.bounded(target), "digest").filter("page_id <> refers_to")
    done.append(_archived(later.select("page_id", "url", "digest", "refers"), folder, "revisit", segment))
    return sorted(r["path"] for d in done for r in d.filter("path is not null").select("path").collect())


#: The header that parse() adds to a record that the end of the archive cuts off.
CUT = "cut"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an opened archive, compressed or not. Where the archive ends within a record or its compression breaks, that is the last one, with what there is of its block and the header CUT."""
    start = stream.read(2)
    whole = io.BufferedReader(_Joined(start, stream), 1 << 20)
    source = io.BufferedReader(_Inflated(whole), 1 << 18) if start == b"\x1f\x8b" else whole
    while True:
        first = source.readline()
        if not first:
            return
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers: dict[str, str] = {}
        while (one := source.readline()).strip():
            name, _, value = one.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"]) if headers.get("content-length", "").isdecimal() else -1
        block = source.read(size) if size > 0 else b""
        if len(block) < size or size < 0 or not one:
            if headers.get("warc-record-id"):
                yield headers | {CUT: "1"}, block
            return
        yield headers, block


class _Inflated(io.RawIOBase):
    """The content of gzip members one after another, as far as they can be read: a cut or broken one ends it with what came out of it so far."""

    def __init__(self, source):
        self.source, self.member, self.rest = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.member is not None:
            self.rest = self.rest or self.source.read(1 << 16)
            if not self.rest:
                return 0
            try:
                out = self.member.decompress(self.rest, len(buffer))
            except zlib.error:
                self.member = None
                return 0
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


class _Joined(io.RawIOBase):
    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.start or self.rest.read(len(buffer))
        self.start = b""
        buffer[: len(got)] = got
        return len(got)


RECORD = "kind string, record_id string, page_id long, digest string, payload_bytes long, refers string, segment int, total long, block binary"


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per record: whole responses with their payload's size and digest, segments with their block, and revisits."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            store, at = shared.filesystem(path)
            rows, held = [], 0
            with store.open_input_stream(at, compression=None) as f:
                for h, block in parse(f):
                    kind = h.get("warc-type")
                    page = int(h["page-id"]) if "page-id" in h else None
                    row = dict.fromkeys(names) | {"record_id": h.get("warc-record-id"), "page_id": page, "digest": h.get("warc-payload-digest", "").removeprefix("sha256:")}
                    if kind == "revisit":
                        row |= {"kind": "revisit", "refers": h.get("warc-refers-to")}
                    elif kind in ("response", "continuation") and "warc-segment-number" in h:
                        total = h.get("warc-segment-total-length")
                        row |= {"kind": "segment", "refers": h.get("warc-segment-origin-id", row["record_id"]), "segment": int(h["warc-segment-number"]), "total": int(total) if total else None, "block": block}
                        held += len(block)
                    elif kind == "response":
                        row |= {"kind": "whole"} | (_NOTHING if CUT in h else checked(block, row["digest"]))
                    else:
                        continue
                    rows.append(row)
                    if len(rows) >= 5000 or held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(shared.tidy(read), RECORD)


RESPONSE = "record_id string, page_id long, digest string, payload_bytes long, complete boolean"


def reassembled(segments: DataFrame) -> DataFrame:
    """The responses that were cut: segments grouped by origin, in order, checked and decoded. A group is one page's."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("complete", pa.bool_())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("refers", "page_id", "digest", "total", "parts")}
                parts = {p["segment"]: p["block"] for p in row["parts"]}
                block = b"".join(parts[k] for k in sorted(parts))
                good = sorted(parts) == list(range(1, len(parts) + 1)) and len(block) == row["total"]
                found = checked(block, row["digest"]) if good else _NOTHING
                rows.append({"record_id": row["refers"], "page_id": row["page_id"], **found, "complete": found["digest"] is not None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")
    grouped = segments.groupBy("refers").agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"), parts)
    return grouped.mapInArrow(shared.tidy(join), RESPONSE)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per page: (page_id, payload_bytes, payload_digest, record_type, refers_to, complete)."""
    found = shared.written(read_records(spark, paths), "records")
    whole = found.filter("kind = 'whole'").selectExpr("record_id", "page_id", "digest", "payload_bytes", "digest is not null complete")
    responses = whole.unionByName(reassembled(found.filter("kind = 'segment'")))
    responses = shared.written(responses, "responses")
    revisits = found.filter("kind = 'revisit'").selectExpr("refers record_id", "page_id", "digest")
    target = responses.filter("complete and page_id is not null").join(revisits.select("record_id").distinct(), "record_id", "left_semi")
    target = shared.bounded(shared.written(target.selectExpr("record_id", "digest", "page_id refers_to", "payload_bytes"), "targets"))
    revisits = revisits.join(target, ["record_id", "digest"], "left")
    return responses.selectExpr("page_id", "payload_bytes", "digest payload_digest", "'response' record_type", "cast(null as long) refers_to", "complete").unionByName(
        revisits.selectExpr("page_id", "payload_bytes", "digest payload_digest", "'revisit' record_type", "refers_to", "refers_to is not null complete")
    )
