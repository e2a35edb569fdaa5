"""Spelling variants: broadcast trie shards, met by every word's distance-one Levenshtein automaton.

Words are maximal runs of LETTERS, A-Z in lower case, of which spelled() leaves out one letter in one
of DROPPED runs of a document, chosen by a checksum of doc_id and run. Words of at least MIN_LETTERS
letters and MIN_ROWS occurrences form the vocabulary. All letters are below U+0100, so a word is one
byte a letter, and bytes sort as code points do.

The sorted vocabulary is cut into compact tries, once as it is read and once from behind. They are
broadcast in waves of at most WAVE_BYTES, however large the vocabulary is. Against each of them every
word's automaton walks depth-first: exactly along one half of the word, then with one insertion,
deletion or replacement in the other half, then exactly to an accepting node. A neighbour differs in
one of the halves, so the two kinds of tries find every one; where equal letters allow several places
of an edit, the last one counts, so none is found twice. Each word's neighbours are reduced where they are
found to a count and the best one (most occurrences, then smallest), and over the waves by aggregation;
pairs are never emitted. Forms rise tenfold with every step, so the roots are found by doubling steps.

Null and empty texts have no words. A null doc_id counts as an empty one in the checksum. Rows count
each for itself, also repeated ones. A run of any length is a word. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LETTERS = "a-zÀ-ÿ"
MIN_LETTERS, MIN_ROWS, DROPPED = 7, 2, 31
#: A near word is a form if it is so many times as frequent.
RATIO = 10
#: Words that a task counts before it passes them on.
HELD_WORDS = 1 << 17
#: Nodes of a trie, and bytes of tries that are broadcast at once (at least one trie, which a longer word than SHARD_NODES exceeds).
SHARD_NODES, WAVE_BYTES = 1 << 19, 32 << 20
#: Words that meet a wave's tries in one task.
TASK_WORDS = 1 << 13


def spelled(doc_id: int | None, run: str) -> str:
    """The run as it counts in a document: without one letter where the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROPPED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks count before they pass on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{MIN_LETTERS},}}")  # shorter ones can't become long enough
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                for word, n in Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    if len(word := spelled(doc_id, word)) >= MIN_LETTERS:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    parts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(shared.tidy(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A trie in breadth-first order: node k + 1 hangs on edge k, and the edges of a node stand together, sorted."""

    def __init__(self, labels: bytes, first: bytes, ends: bytes, counts: bytes):
        """first: of each node its first edge; ends and counts: the accepting nodes and their occurrences."""
        self.labels = labels
        self.first, self.ends, self.counts = array("I", first), array("I", ends), array("q", counts)

    @staticmethod
    def pack(words: list[tuple[bytes, int]]) -> dict[str, bytes]:
        """The parts of a trie of sorted distinct words."""
        labels, children, levels = [bytearray()], [[0]], [[]]  # by depth: letters, numbers of children, accepting nodes
        before = b""
        for word, n in words:
            same = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                same += 1
            for depth in range(same + 1, len(word) + 1):
                if depth == len(labels):
                    labels.append(bytearray())
                    children.append([])
                    levels.append([])
                labels[depth].append(word[depth - 1])
                children[depth - 1][-1] += 1
                children[depth].append(0)
            levels[len(word)].append((len(children[len(word)]) - 1, n))
            before = word
        first, ends, counts, total, node = array("I"), array("I"), array("q"), 0, 0
        for below, accepting in zip(children, levels, strict=True):
            for at, n in accepting:
                ends.append(node + at)
                counts.append(n)
            for c in below:
                first.append(total)
                total += c
            node += len(below)
        first.append(total)
        return {"labels": b"".join(labels), "first": first.tobytes(), "ends": ends.tobytes(), "counts": counts.tobytes()}

    def follow(self, node: int, letters: bytes) -> int:
        """The node that these letters lead to, or -1."""
        first, find = self.first, self.labels.find
        for x in letters:
            node = find(x, first[node], first[node + 1]) + 1
            if not node:
                return -1
        return node

    def accepted(self, node: int, letters: bytes) -> int:
        """Occurrences of the word that ends where these letters lead to, or 0."""
        node = self.follow(node, letters)
        if node < 0:
            return 0
        k = bisect_left(self.ends, node)
        return self.counts[k] if k < len(self.ends) and self.ends[k] == node else 0

    def near(self, word: bytes, mirrored: bool) -> Iterator[tuple[bytes, int]]:
        """The words at distance one with the edit in the second half; mirrored, for a trie of words from behind: in the first half."""
        first, labels, size = self.first, self.labels, len(word)
        half = size // 2
        if not mirrored:
            node = self.follow(0, word[:half])
            for i in range(half, size + 1):
                if node < 0:
                    return
                here = word[i] if i < size else -1
                if i < size and (i + 1 == size or here != word[i + 1]) and (n := self.accepted(node, word[i + 1 :])):
                    yield word[:i] + word[i + 1 :], n
                follow = -1
                for e in range(first[node], first[node + 1]):
                    x = labels[e]
                    if x == here:
                        follow = e + 1
                        continue
                    if n := self.accepted(e + 1, word[i:]):
                        yield word[:i] + bytes((x,)) + word[i:], n
                    if i < size and (n := self.accepted(e + 1, word[i + 1 :])):
                        yield word[:i] + bytes((x,)) + word[i + 1 :], n
                node = follow
            return
        back = word[::-1]
        node = self.follow(0, back[: size - half])  # stands before word[half:]
        for i in range(half - 1, -1, -1):
            if node < 0:
                return
            here, rest = word[i], back[size - i :]  # rest: word[:i] from behind
            if here != word[i + 1] and (n := self.accepted(node, rest)):
                yield word[:i] + word[i + 1 :], n
            follow = -1
            for e in range(first[node], first[node + 1]):
                x = labels[e]
                if x == here:
                    follow = e + 1
                elif n := self.accepted(e + 1, rest):
                    yield word[:i] + bytes((x,)) + word[i + 1 :], n
            node = follow
            if node < 0:
                return
            for e in range(first[node], first[node + 1]):  # inserted before i
                if labels[e] != here and (n := self.accepted(e + 1, rest)):
                    yield word[:i] + bytes((labels[e],)) + word[i:], n


def shards(words: DataFrame, letters: int, mirrored: bool) -> DataFrame:
    """Packed tries of consecutive words, in the order of the words or of the words from behind."""
    key = F.reverse("word") if mirrored else F.col("word")
    ordered = words.select(key.alias("key"), "n").repartitionByRange(1 + letters // SHARD_NODES, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            parts = Trie.pack(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"mirrored": [mirrored], "bytes": pa.array([sum(map(len, parts.values()))], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in parts.items()})

        for batch in batches:
            for word, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append((word.encode("latin-1"), n))
                if (total := total + len(word)) >= SHARD_NODES:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return ordered.mapInArrow(shared.tidy(run), "mirrored boolean, bytes long, labels binary, first binary, ends binary, counts binary")


def waves(tries: DataFrame) -> Iterator[list[tuple]]:
    """The packed tries in lists of at most WAVE_BYTES, one list at a time at the driver."""
    sizes = tries.select("id", "bytes").orderBy("id").toArrow()
    held: list[int] = []
    total = 0
    for at, size in zip(sizes["id"].to_pylist(), sizes["bytes"].to_pylist(), strict=True):
        if held and total + size > WAVE_BYTES:
            yield _fetched(tries, held)
            held, total = [], 0
        held.append(at)
        total += size
    if held:
        yield _fetched(tries, held)


def _fetched(tries: DataFrame, ids: list[int]) -> list[tuple]:
    rows = tries.filter(F.col("id").between(ids[0], ids[-1])).select("mirrored", "labels", "first", "ends", "counts").toArrow()
    return list(zip(*(rows[c].to_pylist() for c in rows.column_names), strict=True))


def neighbours(words: DataFrame, n_words: int, letters: int) -> DataFrame:
    """(word, n, n_near, best_n, best) of the words that have neighbours. words: a written table (word, n)."""
    spark: SparkSession = words.sparkSession
    tries = shards(words, letters, False).unionByName(shards(words, letters, True))
    tries = shared.written(tries.withColumn("id", F.monotonically_increasing_id()), "tries")
    parts = [words.selectExpr("word", "n", "0L n_near", "0L best_n", "word best").limit(0)]
    dealt = words.repartition(1 + n_words // TASK_WORDS, "word")
    for wave in waves(tries):
        sent = spark.sparkContext.broadcast(wave)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            met = [(mirrored, Trie(*parts)) for mirrored, *parts in sent.value]
            for batch in batches:
                rows = []
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    count, most, best = 0, 0, b""
                    key = word.encode("latin-1")
                    for mirrored, trie in met:
                        for other, m in trie.near(key, mirrored):
                            count += 1
                            if m > most or m == most and other < best:
                                most, best = m, other
                    if count:
                        rows.append((word, n, count, most, best.decode("latin-1")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "n_near", "best_n", "best"])

        parts.append(shared.written(dealt.mapInArrow(shared.tidy(run), "word string, n long, n_near long, best_n long, best string"), "near"))
        sent.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.encode("best", "iso-8859-1").alias("b"))).alias("t")
    return every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("t.m")).alias("best_n"), F.decode("t.b", "iso-8859-1").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form, root) from (word, form): each round doubles the steps a root is away. Forms rise by RATIO, so there are few rounds."""
    rooted = forms.withColumn("root", F.col("form"))
    while True:
        ahead = rooted.selectExpr("word root", "root ahead")
        rooted = shared.written(rooted.join(ahead, "root", "left").selectExpr("word", "form", "coalesce(ahead, root) root", "ahead is not null moved"), "roots")
        if rooted.filter("moved").isEmpty():
            return rooted.drop("moved")
        rooted = rooted.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = shared.written(count_words(docs).filter(F.col("n") >= MIN_ROWS), "vocabulary")
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters")).first()
    near = shared.written(neighbours(words, size["n"], size["letters"]), "neighbours")
    forms = near.filter(F.col("best_n") >= RATIO * F.col("n")).select("word", F.col("best").alias("form"))
    rooted = _roots(forms)
    out = words.join(near.select("word", "n_near", "best_n"), "word", "left").join(rooted, "word", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("best_n"))
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
