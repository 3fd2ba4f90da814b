import random
from datetime import datetime, timedelta, timezone

import pytest

from sparkloom.streaming import keyed as K

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, ts timestamp, user_id int, event_type string"


def events(n=160):
    rng, out, at = random.Random(6), [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 5, 40, 700, 4000]), microseconds=rng.randrange(1000))
        out.append((i, at, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "click", "purchase", "error"])))
    return out


def us(at):
    return (at - START) // timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000


def brute(rows, machine, passed):
    """Each key's machine over its sorted events, then whatever runs out up to ``passed``."""
    out = set()
    for key in {r[2] for r in rows}:
        state = None
        for at, i, kind in [*sorted({(us(r[1]), r[0], r[3]) for r in rows if r[2] == key}), (passed + 1, None, None)]:
            wake = machine.wake(state)
            while wake is not None and wake < at:
                state, got = machine.woken(state)
                out |= {(key, *g) for g in got}
                wake = machine.wake(state)
            if i is not None:
                state, got = machine.step(state, at, i, kind)
                out |= {(key, *g) for g in got}
    return {tuple(x.timestamp() if hasattr(x, "timestamp") else x for x in r) for r in out}


def run(spark, folder, stream, machine, late):
    out = K.in_order(stream, "user_id", machine, late)
    q = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return {tuple(x.replace(tzinfo=timezone.utc).timestamp() if hasattr(x, "timestamp") else x for x in r) for r in spark.read.schema(out.schema).parquet(f"{folder}/rows").collect()}


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


@pytest.mark.parametrize("machine", [K.Journal(), K.Leases(1800), K.Anchors(1800)], ids=lambda m: type(m).__name__)
def test_stream_equals_sorted_table_whatever_the_order_of_arrival(spark, tmp_path, machine):
    rng, folder, rows = random.Random(1), f"file://{tmp_path}", events()
    shuffled = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 3000)), r[0]))  # up to 50 minutes late
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for a in range(0, 120, 40):
        write(spark, folder, shuffled[a : a + 40] + shuffled[a + 30 : a + 40])  # some come twice
    first = run(spark, folder, stream, machine, "1 hour")
    write(spark, folder, shuffled[120:] + shuffled[110:120])  # the stream goes on from its checkpoint
    flush = (9999, START + timedelta(days=400), 7, "view")
    write(spark, folder, [flush])
    whole = run(spark, folder, stream, machine, "1 hour")
    passed = us(flush[1] - timedelta(hours=1))
    want = brute(rows, machine, passed)
    assert whole == want and first <= whole and len(want) > 20


def test_what_comes_too_late_is_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    write(spark, folder, [(1, START, 1, "view"), (2, START + timedelta(hours=9), 1, "view")])
    write(spark, folder, [(6, START + timedelta(hours=9, minutes=10), 1, "view")])
    write(spark, folder, [(3, START + timedelta(hours=1), 1, "view"), (4, START + timedelta(hours=8, minutes=30), 1, "view")])
    write(spark, folder, [(5, START + timedelta(days=40), 2, "view")])
    assert run(spark, folder, stream, K.Journal(), "1 hour") == {(1, 1, 1), (1, 4, 2), (1, 2, 3), (1, 6, 4)}


def test_machines_take_one_event_at_a_time():
    m = K.Leases(10, most=2)
    state, out = None, []
    for at, kind in ((0, "click"), (8_000_000, "view"), (40_000_000, "view"), (70_000_000, "purchase"), (99_000_000, "view")):
        while m.wake(state) is not None and m.wake(state) < at:
            state, got = m.woken(state)
            out += got
        state, got = m.step(state, at, 1, kind)
        out += got
    assert [(r[0].timestamp(), *r[1:]) for r in out] == [(18.0, "queued", 1), (50.0, "dead_letter", 2)] and state == (109_000_000, 0)


def test_a_batch_of_a_key_waits_as_one_row():
    """Every row of a state costs a call to it, so work would grow with events instead of keys."""
    calls = []

    class Handle:
        def getListState(self, name, schema):
            return self

        getValueState = getListState

        def registerTimer(self, ms):
            calls.append(("timer", ms))

        def appendList(self, rows):
            calls.extend(("row", r) for r in rows)

        def appendValue(self, row):
            calls.append(("row", row))

    own = K.InOrder(K.Journal())
    own.init(Handle())
    part = lambda n: K.pd.DataFrame({"at": range(1000, 1000 + n), "event_id": range(n), "kind": ["click"] * n})
    assert list(own.handleInputRows(("=1",), iter([part(50), part(20)]), None)) == []
    assert [x[0] for x in calls] == ["row", "timer"] and calls[1][1] == 1
