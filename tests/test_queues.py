import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators import queues


@pytest.mark.parametrize("room", [1, 3, 10])
def test_queue_against_a_sequential_one(spark, room, monkeypatch):
    monkeypatch.setattr(queues, "FAN", 4)
    rng = random.Random(room)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([0, 0, 1, 1, 2, 7, None, -3]), "x" * (k % 3)) for k in rng.sample(range(3000), 700)]
    df = spark.createDataFrame(rows, "link long, k long, s int, note string").withColumn("level", F.lit(99)).repartition(3)
    want, level = {}, {}
    for link, k, s, note in sorted(rows, key=lambda r: r[1]):
        now = max(0, level.get(link, 0) - max(0, s or 0))
        want[link, k] = (note, min(room, now + 1), now == room)
        level[link] = min(room, now + 1)
    for size in (16, 100, 10_000):
        got = queues.admit(df, room=room, served=F.col("s"), by=queues.by_number("k", size))
        assert {(r.link, r.k): (r.note, r.level, r.dropped) for r in got.collect()} == want
        assert got.count() == len(rows)
    assert any(d for *_, d in want.values())
    assert queues.admit(df.limit(0), room=room, served=F.col("s")).count() == 0


def test_no_window_over_a_key_alone(spark):
    plan = queues.admit(spark.range(9).withColumn("link", F.lit(1)), room=2, served=F.lit(1), order=("id",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    with pytest.raises(ValueError, match="room"):
        queues.admit(spark.range(1), room=0, served=F.lit(1), key="id", order=("id",))
