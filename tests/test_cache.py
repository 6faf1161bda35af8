import random
from collections import OrderedDict
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.streaming import cache

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp"


def made(n, seed=1):
    rng, start, out, now = random.Random(seed), datetime(2024, 1, 1), [], 0
    for i in range(n):
        now += rng.choice([0, 5, 60, 900, 4000])
        out.append((i, rng.choice([1, 2, 3]), rng.choice(["a", "b", "c", "d", None]), start + timedelta(seconds=now)))
    return out


def brute(rows, capacity, ttl):
    """Hits by the words: used before, not too long ago, and fewer than capacity others since."""
    out = {}
    for user in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0]))
        for n, r in enumerate(own):
            last = max((m for m in range(n) if own[m][2] == r[2]), default=None)
            out[r[0]] = last is not None and (r[3] - own[last][3]).total_seconds() <= ttl and len({x[2] for x in own[last + 1 : n]}) < capacity
    return out


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 40)), max_size=40), st.integers(1, 4), st.integers(0, 60))
@settings(deadline=None)
def test_touch(steps, capacity, ttl):
    held, now, rows, got = OrderedDict(), 0, [], {}
    for i, (item, wait) in enumerate(steps):
        now += wait
        rows.append((i, 1, item, datetime(2024, 1, 1) + timedelta(seconds=now)))
        got[i] = cache.touch(held, item, now, capacity, ttl)
        assert len(held) <= capacity
    assert got == brute(rows, capacity, ttl)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = made(120)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = cache.accesses(spark.readStream.schema(SCHEMA).parquet(source), capacity=2, ttl=3600)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    for part in (rows[:50], rows[50:51], rows[51:]):
        spark.createDataFrame(random.Random(2).sample(part, len(part)), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    got = spark.read.parquet(out).collect()
    assert {r.event_id: r.hit for r in got} == brute(rows, 2, 3600) and len(got) == len(rows)
    assert {r.event_id: r.event_type for r in got} == {r[0]: r[2] for r in rows}


def test_keys_share_a_group(spark, tmp_path):
    """Each key has its own cache, whatever keys are in its group, and a restart changes nothing; one call a group."""
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, rng.randrange(40), rng.choice(["a", "b", "c", None]), start + timedelta(seconds=400 * i)) for i in range(600)]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    out = str(tmp_path / "out")
    for part in (rows[:250], rows[250:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = cache.accesses(spark.readStream.schema(SCHEMA).parquet(source), capacity=2, ttl=9000, groups=3)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 3
    assert {r.event_id: r.hit for r in spark.read.parquet(out).collect()} == brute(rows, 2, 9000)
