"""Stateful streams over several micro-batches and restarts, the monitor's versions, and the schedule."""

import random
import time

from pyspark.sql import functions as F

from pagewake.operators import governance, site_events
from pagewake.streaming import gateway, monitor

REQUESTS = "id bigint, origin string, at double, ts timestamp"


def requests(seed=3, n=400):
    """Requests in order of time, some at the same time, of a few origins."""
    rnd, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rnd.choice([0, 1, 5, 40])
        out.append((i, rnd.choice("abbbc"), t))
    return out


def put(spark, rows, folder):
    frame = spark.createDataFrame(rows, "id bigint, origin string, at double").withColumn("ts", F.timestamp_seconds("at"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_budget_windows_over_batches_and_a_restart_equal_the_batch_fold(spark, tmp_path):
    rows = requests()
    folder = str(tmp_path / "in")
    for cut in range(0, 300, 100):
        put(spark, rows[cut : cut + 100], folder)
    run = lambda: gateway.append(gateway.budget_windows(source(spark, folder), 100, 7), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    put(spark, rows[300:], folder)  # a restart goes on with windows that are open
    run()
    batch = governance.budget_windows(spark.createDataFrame(rows, "id bigint, origin string, at double"), "origin", "at", 100, 7)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_policies_hit_miss_and_expire(spark, tmp_path):
    rows = requests(7)
    folder = str(tmp_path / "in")
    for cut in range(0, 400, 100):
        put(spark, rows[cut : cut + 100], folder)
    gateway.append(gateway.cached_policies(source(spark, folder), 90.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    held, want = {}, []
    for i, origin, at in rows:
        hit = origin in held and at < held[origin] + 90
        outcome = "hit" if hit else "expired" if origin in held else "miss"
        held[origin] = held[origin] if hit else at
        want.append((i, outcome, held[origin], held[origin] + 90))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert {w[1] for w in want} == {"hit", "miss", "expired"}


CAPTURES = "site string, seq bigint, text string, links array<string>"


def test_events_of_captures(spark):
    many = [f"https://a.org/{i}" for i in range(12)]
    rows = [
        ("a", 1, "same  text", ["x"]), ("a", 2, "same text ", ["x"]), ("a", 3, "other", ["x", *many, "https://a.org/f.PDF"]),
        ("b", 1, None, None), ("b", 2, "", None), ("b", 3, "t", ["u", "u"]), ("c", 9, "alone", ["y.pdf"]),
    ]
    found = {(r.site, r.seq, r.change_type): (r.summary, r.sample) for r in site_events.events(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert found == {
        ("a", 3, "new_content"): ("Content changed on a", ""),
        ("a", 3, "new_links"): ("13 new links found on a", "\n".join(many[:10])),
        ("a", 3, "new_document"): ("1 new document links on a", "https://a.org/f.PDF"),
        ("b", 3, "new_content"): ("Content changed on b", ""),
        ("b", 3, "new_links"): ("2 new links found on b", "u\nu"),
    }


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    m = monitor.Monitor(str(tmp_path / "monitor"))
    rows = [(s, n, f"{s} {n // 2}", [f"l{n}"]) for n in range(1, 7) for s in "abc"]
    stream = lambda: spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(folder)
    for n in range(1, 6):
        spark.createDataFrame([r for r in rows if r[1] == n], CAPTURES).coalesce(1).write.mode("append").parquet(folder)
    m.run(stream()).awaitTermination()
    whole = lambda: sorted(tuple(r)[:5] for r in m.events(spark).collect())
    before = whole()
    assert before == sorted(tuple(r) for r in site_events.events(spark.createDataFrame(rows[:15], CAPTURES)).collect())
    m.apply(spark.createDataFrame([r for r in rows if r[1] == 5], CAPTURES), 4)
    assert whole() == before
    spark.createDataFrame([r for r in rows if r[1] == 6], CAPTURES).coalesce(1).write.mode("append").parquet(folder)
    m.run(stream()).awaitTermination()  # after a restart
    assert whole() == sorted(tuple(r) for r in site_events.events(spark.createDataFrame(rows, CAPTURES)).collect())
    assert sorted(r.seq for r in m.state(spark, 5).collect()) == [6, 6, 6]


def test_a_failing_tick_is_recorded_and_the_next_one_runs(spark, tmp_path):
    folder, done = str(tmp_path / "in"), []

    def apply(batch, number):
        if number == 0:
            raise ValueError("no network")
        done.append((number, batch.count()))

    listener = monitor.Runs()
    spark.streams.addListener(listener)
    spark.createDataFrame([("a", 1, "t", [])], CAPTURES).write.parquet(folder)
    query = monitor.scheduled(spark.readStream.schema(CAPTURES).parquet(folder), apply, str(tmp_path / "run"), "1 second")
    try:
        deadline = time.time() + 60
        while not (tmp_path / "run" / "failures" / "batch=0" / "_SUCCESS").exists() and time.time() < deadline:
            time.sleep(0.2)
        spark.createDataFrame([("b", 1, "t", []), ("c", 1, "t", [])], CAPTURES).write.mode("append").parquet(folder)
        while not done and time.time() < deadline:
            time.sleep(0.2)
        assert query.isActive and done[0][0] == 1
    finally:
        query.stop()
        time.sleep(1)
        spark.streams.removeListener(listener)
    (failure,) = spark.read.parquet(str(tmp_path / "run" / "failures")).collect()
    assert (failure.batch, failure.error) == (0, "ValueError: no network")
    kinds = [kind for _, kind, *_ in listener.rows]
    assert kinds[0] == "started" and "batch" in kinds and kinds[-1] == "ended"
