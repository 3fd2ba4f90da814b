import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import version_store as V
from sparkloom.sources.store import Files

START = datetime(1999, 1, 1)
SCHEMA = "k string, id long, valid_from timestamp_ntz, recorded_at timestamp_ntz, valid_to timestamp_ntz, value int"


def history(n=400, seed=2):
    """Versions in the order in which they are recorded; validity runs ahead of or behind that, and some end by themselves."""
    rng, out, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(hours=rng.randint(0, 60))
        begins = at + timedelta(days=rng.choice([0, 0, 0, -40, 90]), hours=rng.randint(0, 9))
        ends = begins + timedelta(days=rng.choice([0, 1, 30, 400])) if rng.random() < 0.15 else None
        out.append((f"k{rng.randrange(40)}", i, begins, at, ends, rng.randrange(9)))
    return out


def brute(rows, valid, known=None):
    mine = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        mine.setdefault(r[0], []).append(list(r) + [None])
    best = {}
    for k, own in mine.items():
        for i, r in enumerate(own):
            if i + 1 < len(own):
                r[4], r[6] = r[4] or own[i + 1][2], own[i + 1][3]
            ok = r[2] <= valid and (r[4] is None or r[4] > valid or known is not None and r[6] is not None and r[6] > known)
            if ok and (known is None or r[3] <= known):
                best[k] = (i + 1, r[1])
    return {(k, *x) for k, x in best.items()}


def seen(store, *when):
    return {(r.k, r.revision, r.id) for r in store.as_of(*when, columns=["id"]).collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows, root = history(), f"file://{tmp_path_factory.mktemp('versions')}/v"
    for a, b in ((0, 150), (150, 151), (151, 400)):
        store = V.append(spark.createDataFrame(rows[a:b], SCHEMA), root, "k", ["id"])
    return store


INSTANTS = [START + timedelta(days=d, hours=5) for d in (-50, 0, 30, 200, 365, 480, 900)]


@pytest.mark.parametrize("valid", INSTANTS)
def test_as_of_matches_all_history_however_it_was_appended(store, valid):
    rows = history()
    assert seen(store, valid) == brute(rows, valid)
    for known in (START, valid, START + timedelta(days=250), START + timedelta(days=2000)):
        assert seen(store, valid, known) == brute(rows, valid, known)


def test_older_states_and_compaction(spark, store):
    rows = history()
    assert seen(V.opened(spark, store.root, 1), INSTANTS[3]) == brute(rows[:150], INSTANTS[3])
    after = V.compact(spark, store.root)
    assert after.number == 4 and len(after.closed) == 1 and len(store.closed) == 3
    assert seen(after, INSTANTS[4]) == brute(rows, INSTANTS[4]) == seen(store, INSTANTS[4])
    more = [("k1", 999, INSTANTS[6], INSTANTS[6], None, 1), ("new", 1000, INSTANTS[0], INSTANTS[6], None, 1)]
    assert seen(V.append(spark.createDataFrame(more, SCHEMA), store.root, "k", ["id"]), INSTANTS[6]) == brute(rows + more, INSTANTS[6])


def test_filters_reach_the_scan_and_leave_most_history_out(spark, tmp_path):
    days = 3000
    rows = spark.range(days * 20).select(
        F.concat(F.lit("k"), F.col("id") % 20).alias("k"), "id", F.expr("timestamp_ntz '1990-01-01 00:00:00' + make_dt_interval(cast(floor(id / 20) as int))").alias("valid_from"), F.lit(1).alias("value")
    ).withColumn("recorded_at", F.col("valid_from"))
    store = V.append(rows, f"file://{tmp_path}/v", "k", ["id"])
    found = store.near(datetime(1994, 3, 5, 12))
    plan = found._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :][:900]
    assert "cell" in pushed and "valid_from" in pushed
    in_cells = store.versions().where(V.cells_at(store.levels, datetime(1994, 3, 5, 12))).count()
    assert found.count() == 20 and in_cells <= 200
    assert store.versions().count() == days * 20


def test_refused_versions_and_lost_races_leave_nothing(spark, tmp_path):
    root, rows = f"file://{tmp_path}/v", history(20)
    V.append(spark.createDataFrame(rows, SCHEMA), root, "k", ["id"])
    before = Files(spark, root).names(root)
    for bad in ((None, 1, START, START, None, 1), ("k", 1, None, START, None, 1), ("k", 1, START, None, None, 1)):
        with pytest.raises(ValueError):
            V.append(spark.createDataFrame([bad], SCHEMA), root, "k", ["id"])
    with pytest.raises(RuntimeError):
        V.append(spark.createDataFrame(rows, SCHEMA), root, "k", ["id"], expected=0)
    assert Files(spark, root).names(root) == before and V.last(spark, root) == 1
    assert V.append(spark.createDataFrame([], SCHEMA), root, "k", ["id"]).as_of(INSTANTS[3]).count() == len(brute(rows, INSTANTS[3]))
