"""Streams equal batch: incremental scoring and decision state, including
an older decision that arrives in a later file."""

import datetime as dt
import tempfile
import uuid


from cohort_risk.operators import decisions as D
from cohort_risk.plans import views as V
from cohort_risk.streaming import incremental as ST

from .conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_scoring_equals_batch(spark):
    streamed = ST.stream_scoring(spark, SF_SMALL)
    batch = V.scored(spark, SF_SMALL)
    cols = sorted(batch.columns)
    assert sorted(streamed.columns) == cols
    assert _rows(streamed.select(*cols)) == _rows(batch.select(*cols))


def test_stream_decisions_late_older_row_does_not_win(spark):
    base = tempfile.mkdtemp(prefix="decisions-src-")
    schema = "student_id string, subject string, status string, decided_at timestamp_ntz, tie1 bigint, tie2 bigint, tie3 double, tie4 int"
    newer = [("S1", None, "approved", dt.datetime(2024, 1, 5), 1, 1, 1.0, 1)]
    older = [("S1", None, "declined", dt.datetime(2024, 1, 1), 1, 1, 1.0, 1), ("S2", "math", "declined", dt.datetime(2024, 1, 2), 1, 1, 1.0, 1)]
    spark.createDataFrame(newer, schema).write.parquet(f"{base}/src/part1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
    run = uuid.uuid4().hex[:8]
    sink, ckpt = f"{base}/sink-{run}", f"{base}/ckpt-{run}"
    ST.run_current_decisions(spark, stream, sink, ckpt)
    spark.createDataFrame(older, schema).write.parquet(f"{base}/src/part2")
    stream2 = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
    ST.run_current_decisions(spark, stream2, sink, ckpt)  # restart from the checkpoint
    cur = {(r.student_id, r.subject): r.status for r in ST.read_current_decisions(spark, sink).collect()}
    assert cur == {("S1", None): "approved", ("S2", "math"): "declined"}


def test_stream_current_decision_equals_batch(spark):
    streamed = ST.stream_current_decision(spark, SF_SMALL)
    batch = D.current_decisions(V.decisions(spark, SF_SMALL))
    cols = sorted(batch.columns)
    assert _rows(streamed.select(*cols)) == _rows(batch.select(*cols))


def test_many_files_and_a_stopped_stream_are_complete(spark):
    """A stream over many files equals batch, and one that is stopped half-way
    goes on from its checkpoint to the end."""
    import threading
    import time

    from cohort_risk.sources import fixtures as FX

    base = tempfile.mkdtemp(prefix="many-src-")
    FX.students(spark, SF_SMALL).repartition(12).write.parquet(f"{base}/src")
    schema = spark.read.parquet(f"{base}/src").schema
    medians = ST.fit_medians(FX.students(spark, SF_SMALL))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    stopped = []

    def interrupt():
        while not stopped:
            for q in spark.streams.active:
                if any(p["numInputRows"] for p in q.recentProgress):
                    stopped.append(q.id)
                    q.stop()
            time.sleep(0.02)

    t = threading.Thread(target=interrupt, daemon=True)
    t.start()
    ST.run_scoring(spark, stream, medians, f"{base}/sink", f"{base}/ckpt")
    t.join(5)
    assert stopped and spark.read.parquet(f"{base}/sink").count() == 1500


def test_failing_stream_raises(spark):
    import pytest
    from pyspark.sql import functions as F

    from cohort_risk.sources import fixtures as FX

    base = tempfile.mkdtemp(prefix="fail-src-")
    FX.students(spark, SF_SMALL).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/src").schema).parquet(f"{base}/src")
    stream = stream.withColumn("gpa", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        ST.run_scoring(spark, stream, {"gpa": 3.0}, f"{base}/sink", f"{base}/ckpt")


def test_cleared_decisions_and_siblings(spark):
    import shutil

    cut = "1996-01-01 00:00:00"
    base = tempfile.mkdtemp(prefix="sibling-")
    for t in ("lineitem", "orders"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{base}/{t}.parquet")
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{base}/{t}_old.parquet")
    ST.run_current_decisions(spark, ST.stream_decisions(spark, base), f"{base}/sink", f"{base}/ckpt", cleared_at=cut)
    batch = D.current_decisions(V.decisions(spark, SF_SMALL), cleared_at=cut)
    streamed = ST.read_current_decisions(spark, f"{base}/sink")
    cols = sorted(batch.columns)
    assert _rows(streamed.select(*cols)) == _rows(batch.select(*cols))
    assert ST.stream_scoring(spark, base).count() == 1500


def _changes(df):
    return _rows(df.select("student_id", "subject", "status", "decided_at", "previous_status", "changed_from"))


DECISIONS = "student_id string, subject string, status string, decided_at timestamp_ntz, tie1 bigint, tie2 bigint, tie3 double, tie4 int"


def test_stream_decision_changes_equals_batch(spark):
    assert _changes(ST.stream_decision_changes(spark, SF_SMALL)) == _changes(D.decision_changes(V.decisions(spark, SF_SMALL)))


def test_changes_do_not_depend_on_the_order_of_arrival(spark):
    """Random decisions in many files, late ones in any batch, with few and with many rows in the head."""
    import random

    from cohort_risk.streaming import changes as CH

    r = random.Random(7)
    rows = [(r.choice(["S1", "S1", "S2"]), r.choice([None, "math"]), r.choice(["approved", "declined"]), dt.datetime(2024, r.randint(1, 8), r.randint(1, 28), r.randint(0, 23)), r.randint(0, 2), i, 1.0, 1) for i in range(120)]
    base = tempfile.mkdtemp(prefix="late-")
    expected = _changes(D.decision_changes(spark.createDataFrame(rows, DECISIONS)))
    for run, inline in enumerate((0, 1000)):
        r.shuffle(rows)
        for i in range(6):
            spark.createDataFrame(rows[20 * i : 20 * i + 20], DECISIONS).coalesce(1).write.parquet(f"{base}/src{run}/part{i}")
        stream = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(f"{base}/src{run}/*")
        saved, CH.decision_words.__defaults__ = CH.decision_words.__defaults__, (CH.decision_words.__defaults__[0], inline)
        try:
            ST.run_decision_changes(spark, stream, f"{base}/sink{run}", f"{base}/ckpt{run}")
        finally:
            CH.decision_words.__defaults__ = saved
        assert _changes(ST.read_decision_changes(spark, f"{base}/sink{run}")) == expected


def test_keyed_sink_survives_a_stop_at_any_place(spark):
    import os

    from cohort_risk.streaming.keyed_sink import KeyedSink

    base = tempfile.mkdtemp(prefix="keyed-") + "/t"
    sink = KeyedSink(base, ["k"], ["at"], buckets=3, compact_after=4)
    state = {}

    def put(batch, items):
        sink.upsert(spark.createDataFrame([(k, batch, v) for k, v in items.items()], "k int, at int, v string"), batch)
        state.update(items)

    def now():
        return {r.k: r.v for r in sink.read(spark).collect()}

    for batch in range(10):
        put(batch, {k: f"{batch}-{k}" for k in range(batch, batch + 5)})
        assert now() == state
    generation, last = sink.pointer(spark)
    assert generation == 2 and last == 7
    # superseded files go a generation later; a read takes one snapshot and the deltas after it
    assert sorted(os.listdir(f"{base}/snapshot")) == ["generation=1", "generation=2"]
    assert {f.split("=")[1] for f in os.listdir(f"{base}/delta")} == {"4", "5", "6", "7", "8", "9"}
    read = sink.read(spark)
    assert {f.split("/t/")[1].split("/bucket")[0] for f in read.inputFiles()} <= {"snapshot/generation=2", "delta/batch=8", "delta/batch=9"}
    # a snapshot that a stop left without pointer, and a delta without its end, don't count
    spark.createDataFrame([(0, 99, "half")], "k int, at int, v string").withColumn("bucket", sink.bucket()).write.partitionBy("bucket").parquet(f"{base}/snapshot/generation=3")
    spark.createDataFrame([(1, 99, "half")], "k int, at int, v string").withColumn("bucket", sink.bucket()).write.partitionBy("bucket").parquet(f"{base}/delta/batch=10")
    os.remove(f"{base}/delta/batch=10/_SUCCESS")
    assert now() == state
    put(10, {1: "again"})  # the retried batch overwrites its delta
    put(10, {1: "again"})
    assert now() == state and sink.compact(spark) == (3, 10) and now() == state
    put(3, {})  # an old batch that comes again changes nothing
    assert now() == state


def test_a_stop_inside_the_first_batch_does_not_end_the_stream(spark):
    import threading
    import time

    from cohort_risk.sources import fixtures as FX

    base = tempfile.mkdtemp(prefix="first-")
    FX.students(spark, SF_SMALL).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/src").schema).parquet(f"{base}/src")
    stopped, seen = [], []

    def foreach(batch, batch_id):
        seen.append(batch_id)
        if len(seen) == 1:
            threading.Thread(target=lambda: [(stopped.append(q.id), q.stop()) for q in spark.streams.active], daemon=True).start()
            time.sleep(3)  # the stop comes inside this batch
        batch.write.mode("overwrite").parquet(f"{base}/sink/batch={batch_id}")

    ST._run(stream.writeStream.foreachBatch(foreach).option("checkpointLocation", f"{base}/ckpt"), "stopped")
    assert stopped and len(seen) >= 2 and spark.read.parquet(f"{base}/sink").count() == 1500


def test_outbox_sends_one_message_per_event(spark):
    """Replayed events and batches add no message, old decisions that arrive late are not lost."""
    from cohort_risk.operators import interventions as I

    students = V.scored(spark, SF_SMALL, with_ordinal=True)
    ids = [r.student_id for r in students.filter("email IS NOT NULL").select("student_id").orderBy("student_id").limit(40).collect()]
    rows = [(i, None, "approved" if n % 2 else "declined", dt.datetime(2024 - n % 5, 1, 5), n, 1, 1.0, 1) for n, i in enumerate(ids)]
    base = tempfile.mkdtemp(prefix="outbox-")
    for part, some in enumerate((rows[:20], rows[10:30], rows[30:], rows[:5])):  # parts repeat events of earlier ones
        spark.createDataFrame(some, DECISIONS).coalesce(1).write.parquet(f"{base}/src/part{part}")
    stream = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
    ST.run_outbox(spark, stream, students, f"{base}/sink", f"{base}/ckpt")
    expected = I.notification_outbox(spark.createDataFrame(rows, DECISIONS), students)
    got = ST.read_outbox(spark, f"{base}/sink")
    assert _rows(got.select(*expected.columns)) == _rows(expected) and got.count() > 0
    ST.run_outbox(spark, stream, students, f"{base}/sink", f"{base}/ckpt-lost")  # all batches again, without the checkpoint
    assert _rows(ST.read_outbox(spark, f"{base}/sink").select(*expected.columns)) == _rows(expected)


def test_change_stream_keeps_its_state_without_python(spark):
    """State per student, subject and month by Spark's own aggregation, no Python call per student."""
    words = ST.decision_words(ST.stream_decisions(spark, SF_SMALL))
    plan = words._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [student_id" in plan and "TransformWithState" not in plan and "Python" not in plan


def test_a_lone_delta_is_read_as_it_is(spark):
    from cohort_risk.streaming.keyed_sink import KeyedSink

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    base = tempfile.mkdtemp(prefix="lone-")
    batch = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k int, at int, v string")
    sink, plain = KeyedSink(f"{base}/t", ["k"], ["at"], distinct_batches=True), KeyedSink(f"{base}/p", ["k"], ["at"])
    sink.upsert(batch, 0), plain.upsert(batch.unionByName(batch), 0)
    assert exchanges(sink.read(spark)) == 0 and exchanges(plain.read(spark)) > 0
    assert _rows(sink.read(spark)) == _rows(plain.read(spark)) == [(1, 0, "a"), (2, 0, "b")]
    sink.upsert(spark.createDataFrame([(2, 1, "c")], "k int, at int, v string"), 1)
    assert _rows(sink.read(spark)) == [(1, 0, "a"), (2, 1, "c")]


def test_wide_projections_are_compiled(spark):
    """Unless the session says otherwise, a generated method that the JVM would interpret is not used."""
    key = "spark.sql.codegen.hugeMethodLimit"
    fresh = spark.newSession()
    fresh.conf.unset(key)
    V.students(fresh, SF_SMALL)
    assert fresh.conf.get(key) == "8000"
    fresh.conf.set(key, "60000")
    V.students(fresh, SF_SMALL)
    assert fresh.conf.get(key) == "60000"
