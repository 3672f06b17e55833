"""Labelled store: Parquet tables in batches, and versions that say which batches count.

Every write puts its rows into folders of its own, ``<table>/batch=<id>/bucket=<n>``.
Sources share buckets by a hash of their label. A batch counts once a version file lists
it: versions are numbered, each lists all batches in their order, and a version is put in
place by a rename that fails if the number is taken. A writer that comes second looks at
what came in between and tries the next number, or fails with ``ConcurrentWrite`` if its
rows were made for a state that is gone. No clock is read. A reader that holds a version
keeps seeing it until ``vacuum`` removes its files.

The folder has to be on a file system that renames atomically.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions import catalogue as cat

BUCKETS = 64
#: How a batch stands to earlier ones of the same sources; analyses hold no lines.
REPLACE, APPEND, ANALYSES = "replace", "append", "analyses"

_BATCHES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("last_line", T.LongType()),
        T.StructField("last_chunk", T.LongType()),
    ]
)


class ConcurrentWrite(RuntimeError):
    """Another writer changed what this write was made for; read again and repeat it."""


def check_label(label: str) -> str:
    if not label or len(label) > cat.LABEL_CHARS:
        raise ValueError(f"A label has 1 to {cat.LABEL_CHARS} characters: {label!r}")
    return label


def _bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Version:
    """Batches in their order, as ``(id, kind)``. Version 0 is the empty store.

    ``marks`` hold the last number that each repeated writer has noted.
    """

    number: int
    batches: tuple[tuple[str, str], ...]
    marks: tuple[tuple[str, int], ...] = ()

    @property
    def data(self) -> list[str]:
        return [batch for batch, kind in self.batches if kind != ANALYSES]


class Store:
    """Tables below one folder that all executors can reach; ``at`` holds it at a version."""

    def __init__(self, spark: SparkSession, root: str, at: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.held = None if at is None else self._load(at)

    # -- versions ----------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @cached_property
    def _files(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        return sorted(int(name.removesuffix(".json")) for name in self._names("versions") if name.endswith(".json"))

    def _load(self, number: int) -> Version:
        if not number:
            return Version(0, ())
        stream = self._files.open(self._path("versions", f"{number:010d}.json"))
        try:
            listed = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(number, tuple((b["id"], b["kind"]) for b in listed["batches"]), tuple(listed["marks"].items()))

    def version(self) -> Version:
        """The version this store is held at, or else the latest."""
        return self.held or self._load(max(self.versions(), default=0))

    def _put(self, version: Version) -> bool:
        """Puts a version in place; false if its number is taken."""
        batches = [{"id": batch, "kind": kind} for batch, kind in version.batches]
        text = json.dumps({"batches": batches, "marks": dict(version.marks)})
        draft, final = self._path("versions", f"draft-{uuid.uuid4().hex}"), self._path("versions", f"{version.number:010d}.json")
        stream = self._files.create(draft, False)
        stream.write(text.encode())
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, final = (self._files.makeQualified(p) for p in (draft, final))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf()
        )
        no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    # -- writing -----------------------------------------------------------

    @staticmethod
    def new_batch() -> str:
        """A name that no other batch has."""
        return f"b-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str, batch: str) -> DataFrame:
        """Put down the rows of a batch and give them back as stored.

        Files are clustered: a task sorts its rows by gram, source and line number, as far as
        the table has them, so that Parquet's statistics tell which row group holds what.
        """
        order = [c for c in ("gram", "source", "line_no", "chunk") if c in df.columns]
        marked = df.withColumn("bucket", _bucket(F.col("source"))).sortWithinPartitions("bucket", *order)
        marked.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{table}/batch={batch}")
        return self._read(table, df.schema, [batch]).drop("batch")

    def noted(self, name: str, number: int) -> bool:
        """Whether a repeated writer has noted this number, or a later one."""
        return dict(self.version().marks).get(name, -1) >= number

    def publish(
        self,
        sources: DataFrame,
        batch: str,
        kind: str = REPLACE,
        seen: Version | None = None,
        gone: tuple[str, ...] = (),
        mark: tuple[str, int] | None = None,
    ) -> Version:
        """From now on this batch counts for ``sources(source, n_lines, last_line, last_chunk)``.

        It takes the place of what is stored for them, or is added behind it (``append``).
        ``seen`` is the version the rows were made for. If another writer has since touched
        the same sources, or taken away a batch, the write fails. ``gone`` are batches whose
        live rows are in this one; then nothing at all may have changed. ``mark`` is a name and
        a number to note; if they are noted already, the batch doesn't count.
        """
        names = [f.name for f in _BATCHES.fields]
        self.write(sources.select(*names), "batches", batch)
        while True:
            now = self._load(max(self.versions(), default=0))
            if seen is not None and now.number != seen.number:
                self._check(sources, seen, now, bool(gone))
            marks = dict(now.marks)
            if mark is not None:
                if marks.get(mark[0], -1) >= mark[1]:
                    return now
                marks[mark[0]] = mark[1]
            kept = tuple(b for b in now.batches if b[0] not in gone)
            version = Version(now.number + 1, (*kept, (batch, kind)), tuple(marks.items()))
            if self._put(version):
                return version

    def _check(self, sources: DataFrame, seen: Version, now: Version, alone: bool) -> None:
        newer = [b for b in now.data if b not in seen.data]
        if alone and newer or set(seen.data) - set(now.data):
            raise ConcurrentWrite("Batches were added or taken away in between.")
        touched = self._read("batches", _BATCHES, newer).select("source")
        if newer and not sources.select("source").join(touched, "source", "left_semi").isEmpty():
            raise ConcurrentWrite("Another writer has stored lines of the same sources in between.")

    def drop_batches(self, gone: list[str], seen: Version) -> Version:
        """A version without batches that hold nothing live."""
        now = self._load(max(self.versions(), default=0))
        version = Version(now.number + 1, tuple(b for b in now.batches if b[0] not in gone), now.marks)
        if now.number != seen.number or not self._put(version):
            raise ConcurrentWrite("A version was added in between.")
        return version

    def vacuum(self, keep: int = 1, orphans: bool = False) -> list[str]:
        """Removes all but the last ``keep`` versions, and the batches that only those listed.

        With ``orphans`` also batches that no version ever listed: what failed writers left,
        but also what running ones have put down. Readers of removed versions fail.
        """
        numbers = self.versions()
        kept = {b for n in numbers[-keep:] for b, _ in self._load(n).batches}
        listed = {b for n in numbers[:-keep] for b, _ in self._load(n).batches}
        for number in numbers[:-keep]:
            self._files.delete(self._path("versions", f"{number:010d}.json"), False)
        removed = set()
        for table in self._names():
            for folder in self._names(table) if table != "versions" else []:
                batch = folder.removeprefix("batch=")
                if batch != folder and batch not in kept and (orphans or batch in listed):
                    self._files.delete(self._path(table, folder), True)
                    removed.add(batch)
        return sorted(removed)

    # -- reading -----------------------------------------------------------

    def _order(self, version: Version) -> DataFrame:
        """``(batch, at, kind)``, one row per batch of a version."""
        rows = [(batch, at, kind) for at, (batch, kind) in enumerate(version.batches)]
        return self.spark.createDataFrame(rows, "batch string, at int, kind string")

    def live(self, label: str | None = None) -> DataFrame:
        """``(source, batch, at, n_lines, last_line, last_chunk)``: the batches that count for a
        source, its last replacement and what was appended since."""
        version = self.version()
        rows = self._read("batches", _BATCHES, version.data)
        if label is not None:
            rows = self._of(rows, label)
        # At most one row per batch of the version.
        placed = rows.join(F.broadcast(self._order(version)), "batch")
        first = F.max(F.when(F.col("kind") == REPLACE, F.col("at"))).over(Window.partitionBy("source"))
        counts = placed.withColumn("first", F.coalesce(first, F.lit(0))).where("at >= first")
        return counts.select("source", "batch", "at", "n_lines", "last_line", "last_chunk")

    def current(self, label: str | None = None) -> DataFrame:
        """``(source, batch, n_lines, last_line, last_chunk)`` of each stored source: its last
        batch, its lines in all and its ends."""
        return self.live(label).groupBy("source").agg(
            F.max_by("batch", "at").alias("batch"),
            F.sum("n_lines").alias("n_lines"),
            F.max("last_line").alias("last_line"),
            F.max("last_chunk").alias("last_chunk"),
        )

    def appended(self) -> bool:
        """Whether a source may have rows in more than one batch."""
        return any(kind == APPEND for _, kind in self.version().batches)

    def batches_with(self, table: str) -> list[str]:
        """The batches of the version that have rows in a table."""
        there = set(self._names(table))
        return [b for b in self.version().data if f"batch={b}" in there]

    def read(
        self,
        table: str,
        schema: T.StructType,
        label: str | None = None,
        among: list[str] | None = None,
        keep_batch: bool = False,
    ) -> DataFrame:
        """The rows that count, of one source or of all; none if nothing is stored.

        One source reads only its bucket of its batches. A version of one batch holds
        nothing that does not count. ``among`` names the batches to read, if not all.
        """
        every = self.version().data
        data = [b for b in every if among is None or b in among]
        if label is not None:
            batches = [r.batch for r in self.live(label).select("batch").collect() if r.batch in data]
            return self._of(self._read(table, schema, batches), label).drop("batch")
        rows = self._read(table, schema, data)
        if len(every) > 1:
            rows = rows.join(self.live().select("source", "batch"), ["source", "batch"], "left_semi")
        return rows if keep_batch else rows.drop("batch")

    @staticmethod
    def _of(rows: DataFrame, label: str) -> DataFrame:
        number = rows.sparkSession.range(1).select(_bucket(F.lit(label))).first()[0]
        return rows.where((F.col("bucket") == number) & (F.col("source") == label))

    def _read(self, table: str, schema: T.StructType, batches: list[str]) -> DataFrame:
        """Batches of a table as written; empty where they have no rows in it."""
        fields = [f for f in schema.fields if f.name not in ("batch", "bucket")]
        fields += [T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())]
        whole = T.StructType(fields)
        there = set(self._names(table))
        folders = [f"{self.root}/{table}/batch={b}" for b in batches if f"batch={b}" in there]
        if not folders:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{table}").parquet(*folders)
