"""The limiter and tasks in flight: streams equal batches, reservations, cancellations and re-submission."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans import limiter_queries as Q
from graphloom.plans.views import Views
from graphloom.streaming import limiter as M

SF = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def streamed(spark, rows, folder, make, parts=4):
    """Rows as a stream of batches in order of time, through make, collected."""
    own = rows.orderBy("us").collect()
    for i in range(parts):
        spark.createDataFrame(own[i * len(own) // parts : (i + 1) * len(own) // parts], rows.schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    got = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    run = make(stream).writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted(got, key=repr)


def test_limiter_stream_equals_batch(spark, rocks, tmp_path):
    rows = Q.requests(Views(spark, SF)).withColumn("us", F.col("us") + 10**12).cache()  # a row of 1970 would be late
    want = sorted(map(tuple, M.limited(rows, Q.SMALL).collect()), key=repr)
    assert {w[4] for w in want} == {True, False}
    assert streamed(spark, rows, tmp_path, lambda s: M.limited_stream(s, Q.SMALL)) == want


def test_reservations_are_replaced_and_cancelled(spark):
    s = 1_000_000
    rows = [
        (1, "claude-x", "reserve", 1, 0, 5, 1),
        (1, "claude-x", "reserve", 2, 1 * s, 5, 1),  # 10 of 9 tokens: no
        (1, "gpt", "reserve", 3, 1 * s, 5, 1),  # another provider
        (1, "claude-x", "record", 2, 2 * s, 99, 99),  # holds no reservation
        (1, "claude-x", "record", 1, 3 * s, 1, 1),
        (1, "claude-x", "reserve", 4, 3 * s, 8, 1),
        (1, "claude-x", "cancel", 4, 4 * s, None, None),
        (1, "claude-x", "reserve", 5, 5 * s, 8, 1),
        (1, "claude-x", "record", 5, 6 * s, 9, 1),  # more than was estimated
        (1, "claude-x", "reserve", 6, 62 * s, 1, 0),
        (1, "claude-x", "reserve", 7, 63 * s, 1, 0),  # the first record is gone, 9 are left
        (1, "claude-x", "reserve", 8, 66 * s, 9, 0),
        (2, None, "reserve", 9, 0, None, None),
        (None, "gpt", "reserve", 10, 0, 1, 1),
        (2, "gpt", "other", 11, 0, 1, 1),
    ]
    got = {r.reservation: (r.provider, r.admitted, r.retry_us) for r in M.limited(spark.createDataFrame(rows, M.REQUEST), {"anthropic": (10, 10, 10), "openai": (10, 10, 10)}).collect()}
    assert got[1] == ("anthropic", True, 0)
    assert got[2] == ("anthropic", False, 5 * s)
    assert got[3] == ("openai", True, 0)
    assert got[4][1] and got[5][1]
    assert got[6][1:] == (False, s)
    assert got[7][1:] == (False, 3 * s)
    assert got[8][1]
    assert got[9] == ("openai", True, 0)
    assert set(got) == set(range(1, 10))


def test_flight_stream_equals_batch(spark, rocks, tmp_path):
    rows = Q.calls(Views(spark, SF)).cache()
    known = M.admitted_calls(rows, Q.TOKEN)
    want = [tuple(r) for r in M.in_flight(rows, Q.TOKEN).collect()]
    assert {w[2] for w in want} == {"accepted", "already_processing", "unauthorized", "test"}
    plain = [tuple(r) for r in known.filter("status is not null").select("call_id", "task_id", "status").collect()]
    assert sorted([*streamed(spark, rows, tmp_path, lambda s: M.in_flight_stream(s, Q.TOKEN)), *plain], key=repr) == sorted(want, key=repr)


def test_a_task_is_accepted_again_after_its_completion(spark, rocks, tmp_path):
    calls = [("submit", 1), ("submit", 2), ("done", 3), ("done", 4), ("submit", 5), ("submit", 6)]
    rows = spark.createDataFrame([(k, "t", kind, "token x", "r", k) for kind, k in calls], "call_id long, task_id string, kind string, authorization string, repository string, us long")
    want = [(1, "t", "accepted"), (2, "t", "already_processing"), (5, "t", "accepted"), (6, "t", "already_processing")]
    assert sorted(map(tuple, M.in_flight(rows, "x").collect())) == want
    assert streamed(spark, rows, tmp_path, lambda s: M.in_flight_stream(s, "x"), 3) == want
