"""Language identification by fusion of evidence.

The posterior of a language joins four parts: the likelihood of the text under byte-trigram models,
the language that the markup declares (P(declared | language)), the suffix of the address
(P(suffix | language)), and the prior of the host, smoothed towards its suffix and that towards the
whole. All counts behind the last three come from one grouped aggregation over every row, by what
the text alone says; a host with a third of all rows is aggregated before the shuffle like any other.

The trigram models are fitted on labelled rows, those with the smallest hash of their id, TRAIN_ROWS
at most. Labels train and are never fused: the declared language must be another column, or none.
A row is accepted if it has letters and its best language is likely enough.

Null or empty text: no letters, so not accepted; its language is the best by the other evidence, or
null if there is no model. Null declared language, address or host: no evidence of that kind.
Repeated rows get the same result each. Null doc_id stays null, and is classified like others.
Columns that are passed through keep their names; the result's columns replace those of the same
name. An empty table gives no rows; without labelled rows nothing is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import shared

TRAIN_ROWS = 4_000
BUCKETS = 1 << 15
#: Trigrams after which a text's evidence grows no further, and the least posterior to accept.
ENOUGH, ACCEPT = 60.0, 0.6
#: Text-only posterior from which a document counts for the grouped evidence.
SURE = 0.9
#: Pseudo-counts of a host towards its suffix, of a suffix towards the whole, and of the confusion tables.
HOST_WEIGHT, SUFFIX_WEIGHT, CONFUSION_WEIGHT = 20.0, 50.0, 5.0

_TABLE = np.full(256, 32, np.uint8)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams of each text's letters, without those that span a gap."""
    b = _TABLE[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    gap = b == 32
    keep = ~gap[1:-1] & ~(gap[:-2] & gap[2:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep &= row[:-2] == row[2:]
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64), row[:-2][keep]


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # bucket, language

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each language, number of trigrams) of each text; the evidence levels off."""
        bucket, row = trigrams(data, offsets)
        rows = len(offsets) - 1
        n = np.bincount(row, minlength=rows)
        total = np.stack([np.bincount(row, self.log_p[bucket, k], minlength=rows) for k in range(len(self.languages))], axis=1) if self.languages else np.zeros((rows, 0))
        return total / np.maximum(1, n)[:, None] * (ENOUGH * n / (ENOUGH + n))[:, None], n


def posterior(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """Fits the trigram models on rows (doc_id, text, lang): TRAIN_ROWS labelled ones at most."""
    labelled = docs.selectExpr("doc_id", "lower(regexp_extract(lang, '^[A-Za-z]{2,3}', 0)) y").filter("doc_id is not null and y <> ''")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("y").to_pylist()
            for at, data, offsets in K.slices(batch.column("text")):
                bucket, row = trigrams(data, offsets)
                own = np.array(names[at : at + len(offsets) - 1], object)[row]
                for y in set(names[at : at + len(offsets) - 1]):
                    counts[y] = counts.get(y, 0) + np.bincount(bucket[own == y], minlength=BUCKETS)
        for y, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"y": [y] * len(used), "bucket": used, "n": c[used]})

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    found = joined.mapInArrow(shared.tidy(run), "y string, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found["y"].to_pylist(), object)
    languages = sorted(set(names))
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for k, y in enumerate(languages):
        own = names == y
        counts[found["bucket"].to_numpy()[own], k] += found["n"].to_numpy()[own]
    return TextModel(languages, np.log(counts / counts.sum(axis=0)) if languages else counts)


#: What markup hides: an opener, and what ends it. A comment's marks may not overlap.
_HIDDEN = tuple((re.compile(o, re.I | re.A), re.compile(c, re.I | re.A)) for o, c in ((r"<script\b", r"</script\s*>"), (r"<style\b", r"</style\s*>"), ("<!--", "-->")))
_MARK = re.compile("<|&#?[a-z0-9]+;", re.I | re.A)
#: Where markup states its language, tried in this order: a tag, and patterns that follow each other inside it.
_STATED = tuple((re.compile(t, re.I | re.A), tuple(re.compile(p, re.I | re.A) for p in inside)) for t, inside in ((r"<html\b", (r"\s(?:xml:)?lang\s*=\s*[\x22']?\s*([a-z]{2,3})",)), (r"<meta\b", ("content-language", r"content\s*=\s*[\x22']?\s*([a-z]{2,3})"))))


def visible(html: str) -> str:
    """The text without scripts, styles, comments, tags and entities, a gap for each. An opener that is never ended hides nothing, and after the first of a kind no end of it is looked for again: the work is linear."""
    out, at, ended = [], 0, [True] * len(_HIDDEN)
    tags = True
    while (m := _MARK.search(html, at)) is not None:
        start, end = m.start(), m.end() if m.group() != "<" else -1
        if end < 0:
            for k, (opener, closer) in enumerate(_HIDDEN):
                if ended[k] and (o := opener.match(html, start)):
                    c = closer.search(html, o.end())
                    ended[k], end = c is not None, c.end() if c else -1
                    break
            if end < 0 and tags:
                end = html.find(">", start + 1) + 1 or -1
                tags = end > 0
        out.append(html[at : start if end > 0 else start + 1])
        if end > 0:
            out.append(" ")
        at = end if end > 0 else start + 1
    out.append(html[at:])
    return "".join(out)


def stated_language(html: str) -> str | None:
    """The language that the markup declares. What no opener of a tag finds up to the tag's end, no later one before that end finds: each stretch is searched once."""
    for opener, inside in _STATED:
        at = 0
        while (m := opener.search(html, at)) is not None:
            stop = html.find(">", m.end())
            stop = len(html) if stop < 0 else stop
            place, found = m.end(), None
            for pattern in inside:
                found = pattern.search(html, place, stop)
                if found is None:
                    break
                place = found.end()
            if found is not None:
                return found.group(1).lower()
            at = stop
    return None


def of_markup(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, with the visible text of the column html, the language it declares, and its url."""
    kept = pages.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col("url").alias("url"), F.col("html").cast("string").alias("html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("html").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = [], []
            for html in batch.column("html"):
                html = html.as_py()
                texts.append(None if html is None else visible(html))
                said.append(None if html is None else stated_language(html))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(said, pa.string())], [*batch.schema.names[:-1], "text", "declared"])

    out = kept.mapInArrow(shared.tidy(run), f"{fields}, text string, declared string")
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "text", "declared", "url")


def suffix_of(address: Column) -> Column:
    """The last label of an address' host, if it has one that looks like a suffix."""
    host = F.regexp_replace(F.lower(address), "^[a-z][a-z0-9+.-]*://|[/?#:].*$", "")
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1), F.lit(""))


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """log P(value | language) from counts [value, language]."""
    c = counts + CONFUSION_WEIGHT / len(counts)
    return np.log(c / c.sum(axis=0))


@dataclass
class Evidence:
    """What the aggregation gives: small tables for the driver, and one row per host."""

    declared: dict[str, np.ndarray]
    suffix: dict[str, np.ndarray]
    prior: np.ndarray
    hosts: DataFrame


def gather(rows: DataFrame, model: TextModel) -> Evidence:
    """Counts of (host, suffix, declared, language by the text alone) over all rows (text, declared, suffix, host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                log_p, n = model.evidence(data, offsets)
                p = posterior(log_p)
                sure = np.flatnonzero((p.max(axis=1) >= SURE) & (n > 0))
                part = batch.slice(at, len(n)).take(pa.array(sure))
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("suffix"), part.column("declared"), pa.array(p[sure].argmax(axis=1).astype(np.int32))], ["host", "suffix", "declared", "k"])

    size = len(model.languages)
    counted = rows.mapInArrow(shared.tidy(run), "host string, suffix string, declared string, k int").groupBy("host", "suffix", "declared", "k").count()
    counted = shared.written(counted, "evidence")

    def by(name: str) -> dict[str, np.ndarray]:  # a row for each suffix and each code of a language
        out: dict[str, np.ndarray] = {}
        for r in counted.filter(f"{name} is not null").groupBy(name, "k").agg(F.sum("count").alias("n")).collect():
            out.setdefault(r[0], np.zeros(size))[r["k"]] = r["n"]
        return out

    total = np.zeros(size)
    for r in counted.groupBy("k").agg(F.sum("count").alias("n")).collect():
        total[r["k"]] = r["n"]
    prior = (total + 1) / (total + 1).sum()
    declared, suffix = by("declared"), by("suffix")
    tables = []
    for found in (declared, suffix):
        log_p = _smoothed(np.stack(list(found.values()))) if found else np.zeros((0, size))
        tables.append(dict(zip(found, log_p, strict=True)))
    of_suffix = {s: (c + SUFFIX_WEIGHT * prior) / (c.sum() + SUFFIX_WEIGHT) for s, c in suffix.items()}
    n = [F.sum(F.when(F.col("k") == i, F.col("count")).otherwise(0)).alias(f"n{i}") for i in range(size)]
    hosts = counted.filter("host is not null").groupBy("host").agg(F.max("suffix").alias("suffix"), *n)
    names = [f"n{i}" for i in range(size)]

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(x).to_numpy().astype(float) for x in names], axis=1)
            parent = np.stack([of_suffix.get(s, prior) for s in batch.column("suffix").to_pylist()]) if len(c) else c
            p = (c + HOST_WEIGHT * parent) / (c.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(list(np.log(p)), pa.list_(pa.float64()))], ["host", "host_prior"])

    return Evidence(*tables, prior, shared.written(hosts.mapInArrow(shared.tidy(smooth), "host string, host_prior array<double>"), "hosts"))


def classify(docs: DataFrame, keep: list[str], model: TextModel | None = None, declared: str | None = None, address: str | None = "source", host: str | None = "source", accepted_only: bool = False) -> DataFrame:
    """The columns of keep, with declared_lang, text_lang, language, confidence and accepted; or the accepted rows' keep alone.

    Without a model, one is trained on the column lang, which then must not be the declared one too.
    """
    result = [] if accepted_only else ["declared_lang", "text_lang", "language", "confidence", "accepted"]
    keep = [c for c in keep if c not in result]
    none = F.lit(None).cast("string")
    rows = docs.select(
        *(F.col(c).alias(f"keep_{c}") for c in keep),
        F.col("text").alias("text"),
        (F.nullif(F.lower(F.regexp_extract(declared, "^[A-Za-z]{2,3}", 0)), F.lit("")) if declared else none).alias("declared"),
        (suffix_of(F.col(address)) if address else none).alias("suffix"),
        (F.nullif(F.lower(F.regexp_replace(host, "^[A-Za-z][A-Za-z0-9+.-]*://|[/?#:].*$", "")), F.lit("")) if host else none).alias("host"),
    )
    model = train(docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang")) if model is None else model
    kinds = {"declared_lang": "string", "text_lang": "string", "language": "string", "confidence": "double", "accepted": "boolean"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields] + [f"{k} {kinds[k]}" for k in result]
    if not model.languages:
        none = docs.select(*keep, *(F.lit(None).cast(kinds[k]).alias(k) for k in result if k != "accepted"), *([F.lit(False).alias("accepted")] if result else []))
        return none.limit(0) if accepted_only else none
    found = gather(rows.select("text", "declared", "suffix", "host"), model)
    names, size = np.array([*model.languages, None], object), len(model.languages)
    log_prior, said_p, ends_p = np.log(found.prior), found.declared, found.suffix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(size)
        for batch in batches:
            for at, data, offsets in K.slices(batch.column("text")):
                text, n = model.evidence(data, offsets)
                part = batch.slice(at, len(n))
                prior = np.stack([log_prior if p is None else np.array(p) for p in part.column("host_prior").to_pylist()])
                said = np.stack([said_p.get(d, zero) for d in part.column("declared").to_pylist()])
                ends = np.stack([ends_p.get(x, zero) for x in part.column("suffix").to_pylist()])
                p = posterior(text + said + ends + prior)
                best, sure = p.argmax(axis=1), p.max(axis=1)
                ok = (n > 0) & (sure >= ACCEPT)
                kept = [part.column(f"keep_{c}") for c in keep]
                if accepted_only:
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in kept], keep)
                else:
                    yield pa.RecordBatch.from_arrays([*kept, part.column("declared"), pa.array(names[np.where(n > 0, text.argmax(axis=1), size)], pa.string()), pa.array(names[best], pa.string()), pa.array(sure), pa.array(ok)], [*keep, *result])

    if found.hosts.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS:
        joined = rows.join(F.broadcast(found.hosts), "host", "left")
    else:  # rows without a host need no join, and would all meet in one task
        joined = rows.filter("host is not null").join(found.hosts, "host", "left")
        joined = joined.unionByName(rows.filter("host is null"), allowMissingColumns=True)
    return joined.drop("host").mapInArrow(shared.tidy(run), ", ".join(fields))
