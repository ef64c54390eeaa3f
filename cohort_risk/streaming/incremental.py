"""Structured Streaming versions of scoring, decision state and alerts
(I1-I3). The reference has no stream; these run the same logic
incrementally over arriving files.

* I1 scoring: the fit step (feature medians) runs once over the training
  table and yields 10 literals; the stream then labels, fills and categorises
  each arriving row (stateless, append mode).
* I2 decisions: ``groupBy(key).agg(max_by(...))`` in update mode keeps only
  the latest decision per key in the state store (RocksDB); every
  micro-batch's changed keys go to a keyed sink (``keyed_sink``: deltas, compacted
  snapshots, a pointer), so a read costs the state's size. The latest per key
  wins there too, so an older late row can never win.
* I2 / G5 change history: state per key and month (``changes``); late rows correct
  the flips they lie between.
* I3 alerts: I1 filtered to High Risk and narrowed to the alert columns, append mode.
* Quarantine (B3r): arriving rows that break a range rule, append mode.

Checkpoints and sinks live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import rules as R
from ..operators import decisions as D
from ..operators import interventions as I
from ..operators import model as M
from ..operators import quality as Q
from ..session import compiled_projections, scratch_path
from ..sources import fixtures as FX
from ..sources.fixtures import DECISION_ORDER
from .changes import decision_words, joined_months
from .keyed_sink import KeyedSink

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepare_state_store(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, None) or "HDFSBacked" in spark.conf.get(key, ""):
        try:
            spark.conf.set(key, ROCKSDB)
            # commit state as a changelog instead of full snapshots each batch
            spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        except Exception:  # noqa: BLE001 - static in some deployments; keep the default
            pass


def fit_medians(train: DataFrame, cols: list[str] = S.FEATURE_COLUMNS) -> dict[str, float | None]:
    """Training medians of the model features: one aggregate row."""
    cols = [c for c in cols if c in train.columns]
    return Q.column_medians(R.nan_to_null(train), cols)


def score_rows(df: DataFrame, medians: dict[str, float | None], probability_col: str | None = "risk_probability_fixture") -> DataFrame:
    """Stateless scoring of arriving rows: label on raw values, then fill with
    the fitted medians, then category (works on streaming and batch frames)."""
    clean = R.nan_to_null(df)
    out = clean.withColumn("risk_score", R.risk_label(clean))
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in medians.items()})
    out = out.withColumn("risk_category", R.model_category(F.col("risk_score")))
    if probability_col and probability_col in out.columns:
        out = out.withColumn("risk_probability", F.col(probability_col).cast("double")).drop(probability_col)
    return out


def _schema_of(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def _run(query_writer, name: str) -> None:
    """Run a stream until all that its source holds is processed. ``processAllAvailable``
    returns with the query still active only then; a query that something stopped
    half-way (also inside its first batch) is inactive, and is started again from its
    checkpoint. A query that fails raises."""
    while True:
        q = query_writer.trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
            done = q.isActive
        except Exception as e:
            raise RuntimeError(f"stream {name} failed: {e}") from e
        finally:
            q.stop()
        if q.exception() is not None:
            raise RuntimeError(f"stream {name} failed: {q.exception()}")
        if done:
            return


def _file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None) -> DataFrame:
    """A file stream of exactly this table (the bracket makes the name a
    pattern, which a single file needs, without matching any sibling). All
    files at hand are one micro-batch unless ``max_files`` says otherwise."""
    base = sf_dir.rstrip("/")
    compiled_projections(spark)
    reader = spark.readStream.schema(_schema_of(spark, f"{base}/{table}.parquet"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{base}/{table}.parque[t]")


def stream_students(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The student view over a file stream of ``orders``."""
    return _file_stream(spark, sf_dir, "orders", max_files).selectExpr(*[f"{e} AS {n}" for n, e in FX.STUDENT_EXPRS])


def stream_decisions(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    return _file_stream(spark, sf_dir, "lineitem", max_files).selectExpr(*[f"{e} AS {n}" for n, e in FX.DECISION_EXPRS])


ALERT_COLUMNS = ["student_id", "name", "email", "branch", "year", "section", "semester", "gpa", "risk_score", "risk_category", "risk_probability"]


def run_scoring(spark: SparkSession, stream: DataFrame, medians: dict, sink: str, checkpoint: str,
                only_high: bool = False, model=None) -> str:
    """Score arriving rows into a Parquet sink, by rule
    or with a fitted ``model`` (H5); alerts carry only their columns."""
    scored = score_rows(stream, medians)
    if model is not None:
        scored = M.score_for_dashboard(model, scored)
    if only_high:
        scored = scored.filter(F.col("risk_category") == "High Risk")
        scored = scored.select(*[c for c in ALERT_COLUMNS if c in scored.columns])
    w = (
        scored.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    _run(w, "scoring")
    return sink


def run_quarantine(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str) -> str:
    """B3r on arriving rows: those that break a range rule, with the messages."""
    _, bad = Q.quarantine(R.nan_to_null(stream))
    w = (
        bad.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    _run(w, "quarantine")
    return sink


def run_current_decisions(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str, cleared_at: str | None = None) -> str:
    """Latest decision per key as streaming state, upserted per batch;
    ``cleared_at`` drops what was decided before a "clear all"."""
    _prepare_state_store(spark)
    latest = D.current_decisions(stream, cleared_at=cleared_at)

    table = current_sink(sink)
    w = latest.writeStream.outputMode("update").foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    _run(w, "current_decisions")
    return sink


def current_sink(sink: str) -> KeyedSink:
    return KeyedSink(sink, D.KEY, DECISION_ORDER, distinct_batches=True)


def read_current_decisions(spark: SparkSession, sink: str) -> DataFrame:
    """Current state: the last snapshot and the batches after it, latest per key."""
    return current_sink(sink).read(spark)


def run_decision_changes(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str) -> str:
    """G5 as a stream: words on months (``changes``), the last one on each in a keyed sink."""
    _prepare_state_store(spark)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        changes_sink(sink).upsert(batch.withColumn("batch_no", F.lit(batch_id).cast("long")), batch_id)

    w = decision_words(stream).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    _run(w, "decision_changes")
    return sink


def changes_sink(sink: str) -> KeyedSink:
    return KeyedSink(sink, [*D.KEY, "month"], ["batch_no"], distinct_batches=True)


def read_decision_changes(spark: SparkSession, sink: str) -> DataFrame:
    """Every flip known now, as ``operators.decisions.decision_changes`` has them."""
    return joined_months(changes_sink(sink).read(spark))


OUTBOX_KEY = [*D.KEY, *DECISION_ORDER]


def run_outbox(spark: SparkSession, stream: DataFrame, students: DataFrame, sink: str, checkpoint: str, remember: str = "7 days") -> str:
    """C23 as decisions arrive: one message per decision event. Events that come again
    within ``remember`` of their arrival are dropped by the stream; the watermark is on
    the time of arrival, so an old decision that arrives late is not lost. The keyed
    sink holds one message per event, so one that comes again later, or a batch that is
    replayed, adds none."""
    _prepare_state_store(spark)
    arrived = stream.withColumns({"_arrived": F.current_timestamp(), "_line": I.event_subject_line(stream)}).withWatermark("_arrived", remember)
    events = arrived.dropDuplicatesWithinWatermark([*OUTBOX_KEY, "_line"]).drop("_arrived", "_line")
    messages = I.notification_outbox(events, students)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        outbox_sink(sink).upsert(batch.withColumn("batch_no", F.lit(batch_id).cast("long")), batch_id)

    _run(messages.writeStream.outputMode("append").foreachBatch(upsert).option("checkpointLocation", checkpoint), "outbox")
    return sink


def outbox_sink(sink: str) -> KeyedSink:
    return KeyedSink(sink, [*OUTBOX_KEY, "subject_line"], ["batch_no"], distinct_batches=True)


def read_outbox(spark: SparkSession, sink: str) -> DataFrame:
    return outbox_sink(sink).read(spark).drop("batch_no")


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    run = f"streams/{name}-{uuid.uuid4().hex[:12]}"
    return scratch_path(spark, f"{run}/sink"), scratch_path(spark, f"{run}/checkpoint")


def stream_scoring(spark: SparkSession, sf_dir: str, only_high: bool = False) -> DataFrame:
    """Whole pipeline for the registered query: fit medians on the batch
    table, stream the arriving student rows, read the sink back."""
    medians = fit_medians(FX.students(spark, sf_dir))
    sink, ckpt = _paths(spark, "alerts" if only_high else "scoring")
    run_scoring(spark, stream_students(spark, sf_dir), medians, sink, ckpt, only_high)
    return spark.read.parquet(sink)


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, ckpt = _paths(spark, "quarantine")
    run_quarantine(spark, stream_students(spark, sf_dir), sink, ckpt)
    return spark.read.parquet(sink)


def stream_current_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, ckpt = _paths(spark, "decisions")
    run_current_decisions(spark, stream_decisions(spark, sf_dir), sink, ckpt)
    return read_current_decisions(spark, sink)


def stream_decision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, ckpt = _paths(spark, "changes")
    run_decision_changes(spark, stream_decisions(spark, sf_dir), sink, ckpt)
    return read_decision_changes(spark, sink)


def stream_outbox(spark: SparkSession, sf_dir: str, students: DataFrame) -> DataFrame:
    sink, ckpt = _paths(spark, "outbox")
    run_outbox(spark, stream_decisions(spark, sf_dir), students, sink, ckpt)
    return read_outbox(spark, sink)
