import datetime

import pytest

from lumaframe.streaming import watch

SCHEMA = "image_id string, job long, made timestamp, value double"
NOON = datetime.datetime(2024, 1, 1, 12)


def at(minutes):
    return NOON + datetime.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Add rows as a file and run the stream over what is new; each call is a restart from the checkpoint."""
    count = [0]

    def step(*rows, keep="10 minutes"):
        count[0] += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={count[0]}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = watch.current_results(stream, keep).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        # The run's last progress with rows or without tells the state that is left.
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted((r["image_id"], r["job"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), states[-1]

    return step


def test_late_results_of_older_jobs_are_dropped_across_restarts(run):
    first, _ = run(("a", 1, at(0), 1.0), ("b", 5, at(0), 2.0))
    assert first == [("a", 1, 1.0), ("b", 5, 2.0)]
    second, _ = run(("a", 3, at(1), 3.0), ("a", 3, at(1), 3.5), ("b", 4, at(1), 9.0))
    assert second == [("a", 1, 1.0), ("a", 3, 3.0), ("a", 3, 3.5), ("b", 5, 2.0)]
    third, _ = run(("a", 2, at(2), 9.0), ("a", 3, at(2), 3.7), ("b", 6, at(2), 4.0), ("b", 5, at(2), 9.0))
    assert third == [*second[:3], ("a", 3, 3.7), ("b", 5, 2.0), ("b", 6, 4.0)]


def test_state_goes_with_time_and_rows_without_a_job_are_dropped(run):
    _, held = run(*[(f"i{k}", 1, at(0), 0.0) for k in range(20)], ("i1", None, at(0), 1.0))
    assert held == 20
    run(("late", 1, at(60), 0.0))
    rows, held = run(("later", 1, at(61), 0.0))
    assert held < 5 and len(rows) == 22
