"""The calls of a triage session: ingest, append, get lines, get analysis, list sources, compact."""

from __future__ import annotations

import json
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions import catalogue as cat
from logsift.operators import drill, literals, semantic
from logsift.operators import slices as sl
from logsift.operators import templates as tp
from logsift.operators import traces as tr
from logsift.operators.lines import CHUNK_LINES, annotate
from logsift.plans import report
from logsift.plans import wording as w
from logsift.plans.staging import parquet_stage
from logsift.sources.files import read_log_files
from logsift.sources.store import ANALYSES, APPEND, REPLACE, Store, Version, check_label
from logsift.sources.text_column import is_blank, lines_from_text


def _ends(stored: DataFrame) -> DataFrame:
    """How many lines a batch has of each source, and its last ones."""
    return stored.groupBy("source").agg(
        F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"), F.max("chunk").alias("last_chunk")
    )


class Triage:
    """Stored logs of many sources and the reports on them.

    Ingest and append write annotated lines, line groups and the ends of trace pieces;
    everything else reads those tables, so no regex of the classification runs twice. With
    ``at``, the number of a version, the session reads the store as it was then. With
    ``index`` it writes the literal index of lines, which searches use where it exists, and
    with ``slices``, a unit such as ``hour``, counts and sketches by source and slice of time.
    """

    def __init__(
        self, spark: SparkSession, root: str, at: int | None = None, index: bool = False, slices: str | None = None
    ):
        self.spark = spark
        self.store = Store(spark, root, at)
        self.index, self.slices = index, slices

    @cached_property
    def _schemas(self) -> dict[str, T.StructType]:
        """Schemas of the stored tables, also where nothing is stored yet."""
        raw = "source string, chunk bigint, line_no bigint, line string"
        lines = annotate(self.spark.createDataFrame([], raw))
        replies = self.spark.createDataFrame([], "source string, reply string")
        return {
            "lines": lines.schema,
            "groups": tp.line_groups(lines).schema,
            "pieces": tr.ends_only(tr.trace_pieces(lines)).schema,
            "grams": literals.line_grams(lines).schema,
            "slices": sl.time_slices(lines).schema,
            "analyses": semantic.parse_analyses(replies).schema.add("of_batch", T.StringType()),
        }

    def _stored(self, table: str, label: str | None = None) -> DataFrame:
        rows = self.store.read(table, self._schemas[table], label).drop("bucket")
        # Each batch of a log has groups of its own.
        return tp.merged_groups(rows) if table == "groups" and self.store.appended() else rows

    # -- ingest ------------------------------------------------------------

    def ingest(
        self,
        log_text: str | None = None,
        file_path: str | list[str] | None = None,
        label: str = "default",
        enable_semantic: bool = True,
        strip: bool = False,
    ) -> DataFrame:
        """Store one log under a label and return its report ``(source, report)``.

        A text wins over a path. A list of paths, a folder or a glob is stored per file,
        under the files' addresses. A new log has no analysis yet; ``enable_semantic``
        makes the report say so. ``strip`` takes white space off both ends of a text first,
        which shifts the numbers of its lines.
        """
        return self.ingest_lines(self._input(log_text, file_path, label, strip), enable_semantic)

    def append(
        self,
        log_text: str | None = None,
        file_path: str | list[str] | None = None,
        label: str = "default",
        enable_semantic: bool = True,
        strip: bool = False,
    ) -> DataFrame:
        """``ingest`` that goes on where the stored log ends, or starts one; its whole report."""
        return self.append_lines(self._input(log_text, file_path, label, strip), enable_semantic)

    def _input(
        self, log_text: str | None, file_path: str | list[str] | None, label: str, strip: bool
    ) -> DataFrame:
        check_label(label)
        if log_text:
            if not log_text.strip():
                raise ValueError("Log input is empty.")
            texts = self.spark.createDataFrame([(label, log_text)], "source string, text string")
            return lines_from_text(texts, strip)
        many = not isinstance(file_path, str) or (
            any(c in file_path for c in "*?[{") or os.path.isdir(os.path.expanduser(file_path))
        )
        lines = read_log_files(self.spark, file_path, None if many else label)
        if not many and lines.filter(~is_blank(F.col("line"))).isEmpty():
            raise ValueError("Log input is empty.")
        return lines

    def ingest_lines(self, lines: DataFrame, enable_semantic: bool = True) -> DataFrame:
        """Store ``(source, chunk, line_no, line)`` of any number of sources; their reports."""
        return self._reports(*self.store_lines(lines), None, enable_semantic)

    def append_lines(self, lines: DataFrame, enable_semantic: bool = True) -> DataFrame:
        """Add lines, numbered from 1 in each source, to stored logs; the reports of these logs."""
        batch = self.add_lines(lines)
        sources = self.store._read("batches", T.StructType().add("source", T.StringType()), [batch])
        of = [self._stored(n).join(sources, "source", "left_semi") for n in ("lines", "groups", "pieces")]
        return self._reports(*of, None, enable_semantic)

    def store_lines(self, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Store lines without a report; gives back lines, groups and pieces as stored.

        The lines are read once. Readers see the new tables when the last step has put down
        their batch; the analyses of the old log no longer count then.
        """
        batch = self.store.new_batch()
        tables = self._write(annotate(lines), batch)
        self.store.publish(_ends(tables[0]), batch, REPLACE)
        return tables

    def add_lines(self, lines: DataFrame, mark: tuple[str, int] | None = None) -> str:
        """Append lines without a report; gives back the name of their batch.

        Only the new lines are classified. Their numbers and chunks go on after the last ones
        of their source, which the store knows; line groups merge when they are read, and a
        trace over the seam is joined there as one over any two chunks is. A source that
        another writer has changed in the meantime raises ``ConcurrentWrite``. ``mark``, a
        writer's name and a number, lets the same append count only once.
        """
        seen, batch = self.store.version(), self.store.new_batch()
        ends = self.store.current().select("source", "last_line", "last_chunk")
        fields = annotate(lines).columns
        moved = annotate(lines).join(ends, "source", "left").withColumns(
            {
                "line_no": F.col("line_no") + F.coalesce("last_line", F.lit(0)),
                "chunk": F.col("chunk") + F.coalesce(F.col("last_chunk") + 1, F.lit(0)),
            }
        )
        stored, _, _ = self._write(moved.select(fields), batch)
        self.store.publish(_ends(stored), batch, APPEND, seen, mark=mark)
        return batch

    def _write(self, annotated: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        stored = self.store.write(annotated, "lines", batch)
        groups = self.store.write(tp.line_groups(stored), "groups", batch)
        pieces = self.store.write(tr.ends_only(tr.trace_pieces(stored)), "pieces", batch)
        if self.index:
            self.store.write(literals.line_grams(stored), "grams", batch)
        if self.slices:
            self.store.write(sl.time_slices(stored, self.slices), "slices", batch)
        return stored, groups, pieces

    def compact(self) -> Version:
        """Rewrite the batches in which something does not count, or that share a source.

        Live rows of such batches move to one new batch, in files sorted over the whole of a
        bucket; lines are not classified again. Batches that are live as a whole stay as they
        are, those without live rows are left out. ``store.vacuum()`` then removes the files.
        Fails with ``ConcurrentWrite`` if another writer was faster.
        """
        seen = self.store.version()
        live = parquet_stage(self.spark)(self.store.live(), "live")
        shared = live.groupBy("source").agg(F.count("*").alias("parts"))
        # One row per batch of the version.
        held = self.store._read("batches", T.StructType().add("source", T.StringType()), seen.data)
        counts = held.groupBy("batch").agg(F.count("*").alias("n")).collect()
        alive = live.join(shared, "source").groupBy("batch").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
        alive = {r.batch: (r.n, r.parts) for r in alive.collect()}
        dead = [r.batch for r in counts if r.batch not in alive]
        mixed = [r.batch for r in counts if r.batch in alive and alive[r.batch] != (r.n, 1)]
        notes = [b for b, kind in seen.batches if kind == ANALYSES]
        if not mixed and len(notes) < 2:
            return self.store.drop_batches(dead, seen) if dead else seen
        batch = self.store.new_batch()
        lines = self.store._read("lines", self._schemas["lines"], mixed).drop("bucket")
        lines = lines.join(live.select("source", "batch"), ["source", "batch"], "left_semi")
        # The grain of chunks starts anew: many small appends had many small ones.
        lines = lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / CHUNK_LINES)).drop("batch")
        places = lines.repartitionByRange(F.xxhash64("source"), "source", "line_no")
        stored, _, _ = self._write(places, batch)
        moved = self.store._read("batches", T.StructType().add("source", T.StringType()), mixed)
        moved = moved.join(live, ["source", "batch"], "left_semi").select("source").distinct()
        kept = self._analyses(of_batch=True).join(moved.withColumn("moves", F.lit(True)), "source", "left")
        now = F.when(F.col("moves"), F.lit(batch)).otherwise(F.col("of_batch"))
        self.store.write(kept.withColumn("of_batch", now).drop("moves"), "analyses", batch)
        return self.store.publish(_ends(stored), batch, REPLACE, seen, (*dead, *mixed, *notes))

    def add_replies(self, replies: DataFrame) -> DataFrame:
        """Store the analyses in ``(source, reply)``; returns ``(source, reply, reason)`` of
        the replies that hold none.

        An analysis belongs to the log that is stored now. A reply without one takes the
        place of an earlier analysis, too. Replies on sources that are not stored are bad.
        """
        of = self.store.current().select("source", F.col("batch").alias("of_batch"))
        known = replies.join(of, "source", "left").select("source", "reply", "of_batch")
        bad = semantic.bad_replies(known.where("of_batch is not null"))
        strange = known.where("of_batch is null").select(
            "source", "reply", F.lit("unknown source").alias("reason")
        )
        good = semantic.parse_analyses(replies).join(of, "source")
        gone = bad.join(of, "source").select("source", "of_batch")
        rows = good.unionByName(gone, allowMissingColumns=True)
        batch = self.store.new_batch()
        self.store.write(rows, "analyses", batch)
        none = self.spark.createDataFrame([], "source string, n_lines long, last_line long, last_chunk long")
        self.store.publish(none, batch, ANALYSES)
        return bad.unionByName(strange)

    # -- reports -----------------------------------------------------------

    def _analyses(self, label: str | None = None, of_batch: bool = False) -> DataFrame:
        """The last analysis of each source, if it was made for the log stored now."""
        version = self.store.version()
        rows = self.store._read("analyses", self._schemas["analyses"], [b for b, _ in version.batches])
        of = self.store.current(label).select("source", F.col("batch").alias("of_batch"))
        rows = rows.join(of, ["source", "of_batch"]).join(F.broadcast(self.store._order(version)), "batch")
        last = rows.groupBy("source").agg(F.max("at").alias("at"))
        kept = rows.join(last, ["source", "at"]).where("raw_json is not null")
        return kept.drop("batch", "bucket", "at", "kind", *([] if of_batch else ["of_batch"]))

    def _reports(
        self,
        lines: DataFrame,
        groups: DataFrame,
        pieces: DataFrame,
        analyses: DataFrame | None,
        enable_semantic: bool = True,
    ) -> DataFrame:
        tables = report.tables_of(lines, groups, pieces, parquet_stage(self.spark))
        texts = None
        if enable_semantic:
            texts = self.spark.createDataFrame([], "source string, semantic string")
        if analyses is not None:
            texts = semantic.semantic_report(analyses)
        return report.ingest_report(report.summary_report(tables), tables.metrics, texts)

    def reports(self) -> DataFrame:
        """``(source, report)`` of every stored source."""
        names = ("lines", "groups", "pieces")
        return self._reports(*(self._stored(n) for n in names), self._analyses())

    def severity_by_time(self) -> DataFrame:
        """``(source, slice, severity, n)`` of the logs that were stored with slices of time."""
        return sl.severity_by_time(self._stored("slices"))

    def late_lines(self, delay: str) -> DataFrame:
        """``(source, slice, n_late)`` by batches, for a delay such as ``2 hours``."""
        placed = self.store.read("slices", self._schemas["slices"], keep_batch=True)
        order = self.store._order(self.store.version()).select("batch", "at")
        return sl.late_lines(placed.join(F.broadcast(order), "batch"), F.expr(f"INTERVAL {delay}"))

    def digests(self) -> DataFrame:
        """``(source, digest)`` of every stored source."""
        names = ("lines", "groups", "pieces")
        tables = report.tables_of(*(self._stored(n) for n in names), parquet_stage(self.spark))
        return report.analysis_digest(tables)

    # -- drill-down --------------------------------------------------------

    def _known(self, label: str) -> DataFrame:
        """The stored lines of a label; reads only that label's bucket."""
        lines = self._stored("lines", label)
        if lines.isEmpty():
            raise KeyError(self._unknown(label))
        return lines

    def _unknown(self, label: str) -> str:
        """Names some of the stored labels and says how many there are."""
        labels = self.store.current().select("source")
        shown = [r.source for r in labels.orderBy("source").limit(w.LABELS_SHOWN).collect()]
        return w.UNKNOWN_SOURCE.format(label, labels.count(), ", ".join(shown) or "(none)")

    def get_lines(
        self,
        label: str = "default",
        pattern: str | None = None,
        severity: str | None = None,
        max_lines: int = cat.DRILL_LINES,
        around_line: int | None = None,
        context_lines: int = cat.DRILL_CONTEXT,
    ) -> DataFrame:
        """Raw lines of a label: around a line number, or the first matches."""
        lines = self._known(label)
        if around_line is not None:
            return drill.lines_around(lines, label, around_line, context_lines)
        return drill.first_matches(self._matching(pattern, label), None, severity, max_lines)

    def search(
        self, pattern: str, severity: str | None = None, max_lines: int = cat.DRILL_LINES
    ) -> DataFrame:
        """The first matches in each of all stored logs."""
        return drill.first_matches(self._matching(pattern), None, severity, max_lines)

    def _matching(self, pattern: str | None, label: str | None = None) -> DataFrame:
        """Stored lines that match; of batches with an index, only runs that may match are read."""
        indexed = self.store.batches_with("grams")
        if not pattern or not indexed:
            lines = self._stored("lines", label)
            return drill.grep_lines(lines, pattern)
        lines, grams = (self.store.read(t, self._schemas[t], label, indexed).drop("bucket") for t in ("lines", "grams"))
        found = literals.grep_indexed(lines, grams, pattern)
        others = [b for b in self.store.version().data if b not in indexed]
        if not others:
            return found
        rest = self.store.read("lines", self._schemas["lines"], label, others).drop("bucket")
        return found.unionByName(drill.grep_lines(rest, pattern))

    def get_lines_text(
        self,
        label: str = "default",
        pattern: str | None = None,
        severity: str | None = None,
        max_lines: int = cat.DRILL_LINES,
        around_line: int | None = None,
        context_lines: int = cat.DRILL_CONTEXT,
    ) -> str:
        """``get_lines`` as text; at most ``max_lines`` or one window of lines."""
        found = self.get_lines(label, pattern, severity, max_lines, around_line, context_lines)
        if around_line is not None:
            text = drill.render_around(found, around_line, context_lines).first()
            if text:
                return text.text
            total = self.store.current(label).first().n_lines
            return drill.empty_window(total, around_line, context_lines)
        text = drill.render_matches(found, max_lines).first()
        return text.text if text else drill.no_match(pattern, severity)

    # -- analyses and listing ----------------------------------------------

    def get_analysis(self, label: str = "default") -> str:
        """The stored analysis of a label as indented JSON, or a note that there is none."""
        self._known(label)
        row = semantic.get_analysis(self._analyses(label), label).first()
        return json.dumps(json.loads(row.raw_json), indent=2) if row else w.NO_STORED_ANALYSIS

    def list_sources(self) -> DataFrame:
        """``(source, total_lines, unique_lines, errors, has_semantic)``."""
        return report.list_sources(tp.metrics_of(self._stored("groups")), self._analyses())

    def listing(self) -> DataFrame:
        """``(source, text)``: one line of the listing for each stored source."""
        return report.listing(self.list_sources())

    def listing_text(self, most: int = 1_000) -> str:
        """The listing as text; of more than ``most`` sources it shows these and says so."""
        total = self.store.current().count()
        if not total:
            return w.NO_SOURCES
        rows = self.listing().orderBy("source").limit(most).collect()
        cut = [w.MORE_SOURCES.format(total - most)] if total > most else []
        return "\n".join([w.SOURCES, "", *(r.text for r in rows), *cut])
