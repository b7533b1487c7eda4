import pytest
from pyspark.sql import functions as F

from quillspark.operators import leitner, mastery, milestones
from quillspark.plans.fixtures import frame
from quillspark.streaming import stateful


@pytest.fixture(scope="module")
def events(spark, sf):
    return frame(spark, sf, "attempt_events").where("study_code_id < 12").withColumn("attempted_at", F.col("attempted_at").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    """The events as three files in order of time, one a micro-batch."""
    folder = tmp_path_factory.mktemp("events")
    cuts = [r[0] for r in events.selectExpr("explode(percentile_approx(attempted_at, array(0.3, 0.7)))").collect()]
    for k, part in enumerate((events.where(F.col("attempted_at") <= cuts[0]), events.where((F.col("attempted_at") > cuts[0]) & (F.col("attempted_at") <= cuts[1])), events.where(F.col("attempted_at") > cuts[1]))):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_leitner_equals_the_batch_fold(spark, events, stream, tmp_path):
    rows = run(stateful.leitner_updates(stream()), "leitner", "update", tmp_path).collect()
    last = {}
    for r in rows:
        key = (r.study_code_id, r.question_id)
        if key not in last or r.last_reviewed >= last[key].last_reviewed:
            last[key] = r
    got = sorted((k, r.box, r.consecutive_correct) for k, r in last.items())
    want = sorted(((r.study_code_id, r.question_id), r.box, r.consecutive_correct) for r in leitner.leitner_state(events).collect())
    assert got == want


def test_rate_limit_equals_the_batch_fold(events, stream, tmp_path):
    got = {r.event_id: r.allowed for r in run(stateful.rate_limited(stream(), "study_code_id", 6 * 3600, 3, None), "limited", "append", tmp_path).collect()}
    want = {r.event_id: r.allowed for r in leitner.rate_limit(events, "study_code_id", 6 * 3600, 3).collect()}
    assert got == want and not all(want.values())


def test_streaks_equal_the_window(events, stream, tmp_path):
    got = {(r.event_id, r.streak, r.milestone) for r in run(stateful.live_streaks(stream()), "streaks", "append", tmp_path).collect()}
    assert got == {(r.event_id, r.streak, r.milestone) for r in milestones.streaks(events).collect()}


def test_last_active(spark, events, stream, tmp_path):
    renamed = stream().withColumnRenamed("attempted_at", "quiz_date").withColumnRenamed("event_id", "id")
    out = run(stateful.last_active_stream(renamed, "3650 days"), "active", "update", tmp_path)
    got = {r[0]: r[1] for r in out.groupBy("study_code_id").agg(F.max("last_active_at")).collect()}
    want = {r.study_code_id: r.last_active_at for r in mastery.last_active(events.withColumnRenamed("attempted_at", "quiz_date")).collect()}
    assert got == want


def test_every_box_and_answer():
    table = {(1, 0, True): (2, 0), (2, 0, True): (2, 1), (2, 1, True): (3, 0), (3, 0, True): (3, 1), (3, 1, True): (4, 0), (4, 1, True): (4, 2), (4, 2, True): (5, 0), (5, 7, True): (5, 8), (4, 2, False): (1, 0), (5, 9, False): (1, 0)}
    assert {k: stateful.advance(*k) for k in table} == table
