import random
from datetime import datetime, timedelta

from newsloom.operators.dedup import upsert
from newsloom.streaming import incremental, runs, windows

T0 = datetime(2024, 5, 1)


def test_windows_with_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(T0 + timedelta(minutes=m), k, 1.0) for m, k in [(1, "a"), (9, "a"), (11, "a"), (40, "b")]]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(folder)
    # a row that moves the watermark on, so that the windows before are final
    spark.createDataFrame([(T0 + timedelta(hours=9), "z", 1.0)], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    q = windows.windowed(stream, "10 minutes", None, "5 minutes").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.start.hour, r.start.minute, r.event_type): r.n for r in spark.table("late").collect()}
    finally:
        q.stop()
    whole = {(r.start.hour, r.start.minute, r.event_type): r.n for r in windows.windowed(spark.read.parquet(folder), "10 minutes").collect()}
    assert got and all(whole[k] == n for k, n in got.items()) and (9, 0, "z") not in got


def test_sessions_and_usage(spark):
    rows = [(1, T0, 5), (1, T0 + timedelta(minutes=20), 6), (1, T0 + timedelta(hours=2), 7), (2, T0 + timedelta(days=1), 8)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, pages long")
    assert sorted((r.user_id, r.n) for r in windows.sessions(df, "30 minutes").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r.user_id, r.day.day, r.pages) for r in windows.daily_usage(df, key="user_id").collect()) == [(1, 1, 18), (2, 2, 8)]


KIND = "workspace_id long, arrival long, canonical_url string, title string, body string, confidence double"


def test_incremental_store_equals_one_load(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1 + i % 2, i, None if i == 20 else f"u{i % 11}", f"t{i % 3}", f"{long} {i % 4}", 0.9) for i in range(24)]
    store = incremental.ArticleStore(spark, str(tmp_path / "store"), bucket_rows=3, fan=2)
    parts = (rows[:5], [], rows[5:12], rows[12:])
    for batch, part in enumerate(parts):
        store.apply(spark.createDataFrame(part, KIND), batch)
    store.apply(spark.createDataFrame(parts[-1], KIND), len(parts) - 1)  # run again after a failure
    key = lambda r: (r.id, r.workspace_id, r.canonical_url, r.title, r.body, r.duplicate_of)
    want, said = upsert(spark.createDataFrame([], incremental.STORE), spark.createDataFrame(rows, KIND))
    assert sorted(map(key, store.snapshot(4).collect()), key=str) == sorted(map(key, want.collect()), key=str)
    got = [r for batch in range(4) for r in store.outcomes(batch).collect()]
    assert sorted((r.arrival, r.outcome, r.duplicate_of) for r in got) == sorted((r.arrival, r.outcome, r.duplicate_of) for r in said.collect())
    assert store.snapshot(1).count() == 5 and store.snapshot(0).count() == 0
    # an index of the originals' present texts, no others
    present = incremental.index_keys(want.filter("duplicate_of is null")).select("workspace_id", "band", "value", "id")
    assert sorted(map(tuple, store.index.rows(4).select("workspace_id", "band", "value", "id").collect())) == sorted(map(tuple, present.collect()))
    assert store.vacuum(4) > 0 and store.vacuum(4) == 0
    assert sorted(map(key, store.snapshot(4).collect()), key=str) == sorted(map(key, want.collect()), key=str)


RUNS = "k long, id long, v string, live boolean"


def test_runs_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    table = runs.RunTable(spark, str(tmp_path / "t"), RUNS, ["k"], ["k", "id"], bucket_rows=5, fan=3)
    want: dict[tuple[int, int], str] = {}
    states = []
    for batch in range(11):
        fresh = {(rng.randrange(40), rng.randrange(3)): (f"b{batch}", rng.random() < 0.7) for _ in range(rng.choice([0, 1, 12]))}
        table.add(spark.createDataFrame([(*k, *v) for k, v in fresh.items()], RUNS), batch)
        for k, (v, live) in fresh.items():
            want.pop(k, None)
            if live:
                want[k] = v
        states.append(dict(want))
    for before in (11, 4):
        assert {(r.k, r.id): r.v for r in table.rows(before).collect()} == states[before - 1]
    some = spark.createDataFrame([(k,) for k in range(0, 60, 7)], "k long")
    assert {(r.k, r.id): r.v for r in table.lookup(some, 11).collect()} == {k: v for k, v in want.items() if k[0] % 7 == 0}
    assert max(r.level for r in table.held(11)[0]) >= 1
    assert len([r for r in table.held(11)[0] if r.level == 0]) < 3
    table.vacuum(11)
    assert {(r.k, r.id): r.v for r in table.rows(11).collect()} == want and table.held(4) == ([], 0)


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    read = {}
    for size in (400, 6400):
        table = runs.RunTable(spark, str(tmp_path / str(size)), RUNS, ["k"], ["k", "id"], bucket_rows=50)
        table.add(spark.range(size).selectExpr("id k", "0L id", "string(id) v", "true live"), 0)
        asked = table.lookup(spark.createDataFrame([(5,), (77,), (123,)], "k long"), 1)
        assert {r.v for r in asked.collect()} == {"5", "77", "123"}
        read[size] = (len(asked.inputFiles()), spark.read.parquet(*asked.inputFiles()).count())
    # sixteen times the table, and the same share is read
    assert read[6400][0] <= 3 and read[6400][1] <= 3 * 50 * 2 and read[6400][1] <= 2 * read[400][1]


def test_for_each_batch(spark, tmp_path):
    kind = "workspace_id long, arrival long, canonical_url string, title string, body string, confidence double"
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a", "t", "one text", 0.5), (1, 2, "b", "t", "one text", 0.5)], kind).write.parquet(folder)
    store = incremental.ArticleStore(spark, str(tmp_path / "out"))
    q = spark.readStream.schema(kind).parquet(folder).writeStream.foreachBatch(store.apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.canonical_url, r.duplicate_of) for r in store.snapshot(99).collect()) == [("a", None), ("b", 1)]
