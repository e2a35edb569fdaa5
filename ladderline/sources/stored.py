"""Stored tables: an append-only log with commits, a keyed table merged bucket by bucket, checks before anything is written, runs.

Data are Parquet folders that a table's commits name; a folder without a commit is invisible, so a
killed or retried write leaves nothing behind that a reader sees. A commit is a small JSON file put in
place by one rename that fails if the name is taken. All files are reached by Hadoop's file systems, as
Spark's own are.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as S


class Refused(ValueError):
    """A batch that breaks a rule; nothing of it is written. faults: (rule, value, n)."""

    def __init__(self, faults: DataFrame, rules: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in sorted(rules.items())))
        self.faults, self.rules = faults, rules


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.api, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self.fs = self.api.Path(path).getFileSystem(conf)
        self.context = self.api.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, name: str):
        return self.api.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        """The names in a folder, sorted; none if it doesn't exist."""
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def text(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; false if the name is taken."""
        part = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.context.rename(part, self.at(name), self.spark.sparkContext._gateway.new_array(getattr(self.api, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, a local one, but never on a cluster. It goes with the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ladderline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files = Files(spark, path)
    files.fs.mkdirs(files.at(""))
    files.fs.deleteOnExit(files.at(""))
    return path


class Log:
    """An append-only table: a run's rows are one commit, however often it is tried (SNK1)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema, self.files = spark, schema, Files(spark, path)

    def runs(self) -> list[str]:
        return [n for n in self.files.names("_commits") if not n.startswith(".")]

    def append(self, rows: DataFrame, run_id: str, key: list[str] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> bool:
        """Adds the rows as this run's; false, and nothing added, if the run is committed already. With a key or references they are checked first (VAL10)."""
        if run_id in self.runs():
            return False
        folder = f"{run_id}-{uuid.uuid4().hex}"
        try:
            S.conform(rows, self.schema).write.parquet(f"{self.files.root}/data/{folder}")
            if key or references:
                refuse(batch_faults(self._parts([folder]), key, self.read() if key else None, references or {}))
        except BaseException:
            self.files.delete(f"data/{folder}")
            raise
        if self.files.publish(f"_commits/{run_id}", json.dumps({"folder": folder})):
            return True
        self.files.delete(f"data/{folder}")
        return False

    def read(self, runs: list[str] | None = None) -> DataFrame:
        """The rows of whole commits: of all, or of these runs."""
        return self._parts([json.loads(self.files.text(f"_commits/{r}"))["folder"] for r in (self.runs() if runs is None else runs)])

    def _parts(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.files.root}/data/{f}" for f in folders))

    def vacuum(self) -> list[str]:
        """Deletes the folders that no commit names, when no writer is at work."""
        held = {json.loads(self.files.text(f"_commits/{r}"))["folder"] for r in self.runs()}
        lost = [f for f in self.files.names("data") if f not in held]
        for f in lost:
            self.files.delete(f"data/{f}")
        return lost


class Keyed:
    """A table with a key, in buckets by a hash of it. A version names the folders of each bucket; a write makes new ones for the buckets it touches only.

    A bucket is one task's work when it is merged: choose their number so that each fits. A row with a null in its key is equal to no other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.schema, self.key, self.buckets, self.files = spark, schema, key, buckets, Files(spark, path)

    def version(self) -> int:
        return max((int(n) for n in self.files.names("_versions") if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each bucket."""
        v = self.version() if version is None else version
        return json.loads(self.files.text(f"_versions/{v:012}")) if v else {}

    def read(self, version: int | None = None) -> DataFrame:
        return self._of([f for parts in self.parts(version).values() for f in parts])

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.files.root}/data/{f}" for f in folders))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _staged(self, rows: DataFrame) -> tuple[str, list[str]]:
        """The batch written by bucket, and the buckets it touches."""
        name = uuid.uuid4().hex
        S.conform(rows, self.schema).withColumn("_b", self._bucket()).write.partitionBy("_b").parquet(f"{self.files.root}/data/{name}")
        return name, self._touched(name)

    def _touched(self, name: str) -> list[str]:
        return [n.removeprefix("_b=") for n in self.files.names(f"data/{name}") if n.startswith("_b=")]

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("_b").parquet(f"{self.files.root}/data/{name}")
        return name

    def _commit(self, before: int, parts: dict[str, list[str]], made: list[str]) -> int:
        if self.files.publish(f"_versions/{before + 1:012}", json.dumps(parts, sort_keys=True)):
            return before + 1
        for name in made:
            self.files.delete(f"data/{name}")
        raise Conflict(f"version {before + 1} was written by another")

    def merge(self, rows: DataFrame, order: list, at: int | None = None) -> int:
        """Upserts: a row of the batch takes the place of the one with its key, the first in this order where the batch has several (SNK3). at: as in insert(). Returns the version."""
        before = self.version() if at is None else at
        held = self.parts(before)
        staged, touched = self._staged(rows)
        old = self._of([f for b in touched for f in held.get(b, [])]).withColumn("_new", F.lit(0))
        new = self._of([f"{staged}/_b={b}" for b in touched]).withColumn("_new", F.lit(1))
        both = old.unionByName(new).withColumn("_b", self._bucket()).repartition(max(1, len(touched)), "_b")
        known = F.lit(True)
        for k in self.key:
            known &= F.col(k).isNotNull()
        kept = S.last_wins(both.filter(known), ["_b", *self.key], [F.desc("_new"), *order]).unionByName(both.filter(~known)).drop("_new")
        made = self._write(kept)
        self.files.delete(f"data/{staged}")
        return self._commit(before, held | {b: [f"{made}/_b={b}"] for b in touched}, [made])

    def insert(self, rows: DataFrame, order: list, at: int | None = None) -> int:
        """Adds the rows whose key isn't held, of several in the batch the first (SNK2); no stored file is rewritten. at: the version that the rows were made for, if it matters. Returns the version."""
        before = self.version() if at is None else at
        held = self.parts(before)
        staged, touched = self._staged(rows)
        old = self._of([f for b in touched for f in held.get(b, [])])
        fresh = S.first_wins(self._of([f"{staged}/_b={b}" for b in touched]), self.key, order, old)
        made = self._write(fresh.withColumn("_b", self._bucket()).repartition(max(1, len(touched)), "_b"))
        self.files.delete(f"data/{staged}")
        return self._commit(before, held | {b: [*held.get(b, []), f"{made}/_b={b}"] for b in self._touched(made)}, [made])


#: Bits of the bitmap of a batch's keys: at most 2**(KEY_BITS - 6) words, which are broadcast.
KEY_BITS = 23


def among(held: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame:
    """The distinct keys of held that wanted has too: a bitmap of the wanted ones, then an exact join of what passes."""
    slot = F.pmod(F.xxhash64(*key), F.lit(1 << KEY_BITS))
    words = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_bits"))
    near = held.select(*key).withColumn("_s", slot).join(F.broadcast(words), F.shiftright("_s", 6) == F.col("_w"))
    near = near.filter(F.expr("shiftright(_bits, cast(_s & 63 as int)) & 1 = 1")).select(*key)
    return near.join(wanted.select(*key).distinct(), key, "left_semi").distinct()


def batch_faults(batch: DataFrame, key: list[str] | None, held: DataFrame | None, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(rule, value, n): keys that the batch repeats, keys that are held already, references without a parent (VAL10, T13, T29). Nulls are equal to nothing and refer to nothing."""
    out = batch.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"))
    if key:
        text = F.concat_ws("|", *key).alias("value")
        counts = batch.filter(" and ".join(f"`{k}` is not null" for k in key)).groupBy(*key).agg(F.count("*").alias("n"))
        out = out.unionByName(counts.filter("n > 1").select(F.lit("repeated key").alias("rule"), text, "n"))
        if held is not None:
            out = out.unionByName(counts.join(among(held, key, counts), key, "left_semi").select(F.lit("held key").alias("rule"), text, "n"))
    for column, (parent, name) in references.items():
        asked = batch.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
        lost = asked.join(among(parent.select(F.col(name).alias("_k")), ["_k"], asked), "_k", "left_anti")
        out = out.unionByName(lost.select(F.lit(f"no {column}").alias("rule"), F.col("_k").cast("string").alias("value"), "n"))
    return out


def refuse(faults: DataFrame) -> None:
    """Raises Refused if there is any."""
    rules = {r["rule"]: r["n"] for r in faults.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    if rules:
        raise Refused(faults, rules)


class Runs:
    """Loads: a run is written down when it starts, and closed by its id with its counts (SNK7, SNK8)."""

    SCHEMA = "run_id long, started_at timestamp, finished_at timestamp, source_file string, source_sha256 string, schema_version string, row_counts string, note string"
    VERSION = "1"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Keyed(spark, path, self.SCHEMA, ["run_id"], buckets=1)

    def start(self, source: str, note: str = "") -> int:
        """Writes the run's row, and returns its id: the next one, also with several at once."""
        digest = self.spark.read.format("binaryFile").load(source).groupBy().agg(F.sha2(F.max("content"), 256).alias("sha")).select(
            F.current_timestamp().alias("started_at"), F.lit(source).alias("source_file"), F.col("sha").alias("source_sha256"), F.lit(self.VERSION).alias("schema_version"), F.lit(note).alias("note")
        )
        while True:
            at = self.table.version()
            run_id = (self.table.read(at).agg(F.max("run_id")).first()[0] or 0) + 1
            try:
                self.table.insert(digest.withColumn("run_id", F.lit(run_id)), ["run_id"], at)
                return run_id
            except Conflict:
                continue

    def finish(self, run_id: int, counts: DataFrame) -> None:
        """Closes the run with its counts, (name, n), as JSON sorted by name."""
        body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))))
        found = counts.agg(body.alias("row_counts")).withColumn("finished_at", F.current_timestamp())
        while True:
            at = self.table.version()
            row = self.table.read(at).filter(F.col("run_id") == run_id).drop("row_counts", "finished_at")
            if row.isEmpty():
                raise KeyError(run_id)
            try:
                self.table.merge(row.crossJoin(F.broadcast(found)), ["run_id"], at)  # one row each
                return
            except Conflict:
                continue

    def read(self) -> DataFrame:
        return self.table.read()


def recorded(runs: Runs, source: str, load, note: str = "") -> dict[str, DataFrame]:
    """Runs load() as a recorded run: it returns tables by name with the counts in 'report'. A load that fails leaves its row unfinished."""
    run_id = runs.start(source, note)
    tables = load()
    runs.finish(run_id, tables["report"])
    return tables
