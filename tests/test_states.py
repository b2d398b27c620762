"""Stored tables under failures, retries and several writers; sums, the index of ids, and the streams that write them."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F
from test_tables import payload

from stridelake import operators as op
from stridelake import plans, sources, streaming
from stridelake.sources import id_index, states, sums


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def broken(spark, n=10):
    """Rows of which the last cannot be computed, in a file of their own."""
    return spark.range(n, numPartitions=2).select(F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_write_that_fails_midway_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    for write in (sources.write_table, sources.append_table):
        with pytest.raises(Exception, match="lost"):
            write(broken(spark), root)
    assert sources.versions(spark, root) == [] and sources.newest(spark, root) is None
    sources.write_table(spark.range(3), root)
    with pytest.raises(Exception, match="lost"):
        sources.append_table(broken(spark), root, token="b1")
    assert ids(sources.load_table(spark, root)) == [0, 1, 2] and sources.tokens(spark, root) == {}
    sources.append_table(spark.range(3, 5), root, token="b1")
    assert ids(sources.load_table(spark, root)) == [0, 1, 2, 3, 4]
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("_")] == []


def test_what_a_dead_writer_left_is_not_read_and_can_be_cleared(spark, tmp_path):
    root = str(tmp_path / "t")
    sources.write_table(spark.range(3), root)
    spark.range(9).write.parquet(f"{root}/_staging-dead")
    sources.append_table(spark.range(3, 4), root)
    assert ids(sources.load_table(spark, root)) == [0, 1, 2, 3]
    assert sources.clear_staging(spark, root) == 0 and sources.clear_staging(spark, root, 0) == 1
    assert ids(sources.load_table(spark, root)) == [0, 1, 2, 3]


def test_a_retried_batch_is_written_once(spark, tmp_path):
    root = str(tmp_path / "t")
    first = sources.append_table(spark.range(2), root, token="week=1")
    assert sources.append_table(spark.range(7), root, token="week=1") == first
    sources.write_table(spark.range(5, 6), root, token="whole")
    assert sources.append_table(spark.range(7), root, token="week=1") == first
    assert ids(sources.load_table(spark, root)) == [5] and set(sources.tokens(spark, root)) == {"week=1", "whole"}
    with pytest.raises(ValueError, match="token"):
        sources.append_table(spark.range(1), root, token="a/b")


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """Six at once, of which two write the same batch; all take their number at the same time."""
    root, gate, seen = str(tmp_path / "t"), threading.Barrier(6, timeout=60), threading.local()
    real = states.versions

    def late(session, path):
        found = real(session, path)
        if path == root and not getattr(seen, "waited", False):
            seen.waited = True
            gate.wait()
        return found

    monkeypatch.setattr(states, "versions", late)
    errors = []

    def work(i):
        try:
            states.append_table(spark.range(10 * i, 10 * i + 2), root, token=f"b{min(i, 4)}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    found = ids(sources.load_table(spark, root))
    assert not errors and len(sources.versions(spark, root)) == 5
    assert found[:8] == [0, 1, 10, 11, 20, 21, 30, 31] and found[8:] in ([40, 41], [50, 51])
    assert [p.name for p in (tmp_path / "t").rglob("_staging*")] == []


def test_a_change_of_an_old_state_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    sources.write_table(spark.range(1), root, expect="")
    at = sources.newest(spark, root)
    sources.append_table(spark.range(1, 2), root, expect=at)
    for write in (sources.write_table, sources.append_table):
        with pytest.raises(sources.Conflict):
            write(spark.range(9), root, expect=at)
    with pytest.raises(sources.Conflict):
        sources.write_table(spark.range(9), root, expect="")
    assert ids(sources.load_table(spark, root)) == [0, 1] and ids(sources.load_table(spark, root, at)) == [0]


def test_snapshots_and_published_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    for read in (sources.snapshot, sources.load_table):
        with pytest.raises(FileNotFoundError):
            read(spark, root)
    with pytest.raises(FileNotFoundError):
        sources.load_table(spark, root, "s=000000000009")
    tables = {"a": spark.range(2), "b": broken(spark)}
    with pytest.raises(Exception, match="lost"):
        sources.publish(tables, root, "append", token="load-1")
    sources.publish(tables | {"b": spark.range(3)}, root, "append", token="load-1")
    assert (sources.load_table(spark, f"{root}/a").count(), sources.load_table(spark, f"{root}/b").count()) == (2, 3)


def test_reserved_numbers_are_given_again_only_if_their_batch_was_never_written(spark, tmp_path):
    ledger, batches = str(tmp_path / "l"), str(tmp_path / "b")
    assert sources.reserve(spark, ledger, batches, "a", 10) == 1
    assert sources.reserve(spark, ledger, batches, "b", 5) == 1  # a was never written
    sources.write_table(spark.range(5), batches, token="b", expect="")
    with pytest.raises(sources.Conflict):
        sources.write_table(spark.range(10), batches, token="a", expect="")
    assert sources.reserve(spark, ledger, batches, "c", 0) == 6 and sources.reserve(spark, ledger, batches, "d", 4) == 6


STEPS = ["serials", "-new", "acts", "-sums", "meta"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_serials_after_a_crash_at_every_step_followed_by_other_rows(spark, tmp_path, monkeypatch, step, after):
    """A run breaks before or after one of its writes; the next one brings other rows. Serials are gapless, metrics those of all rows."""
    store, meta = str(tmp_path / "acts"), str(tmp_path / "meta")
    raw = lambda *a: spark.createDataFrame([payload(*a)], "`JSON Data` string, Name string")
    real = states._write

    def breaks(df, root, *more):
        hit = root.endswith(step)
        if hit and not after:
            raise RuntimeError("lost")
        out = real(df, root, *more)
        if hit:
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(states, "_write", breaks)
    with pytest.raises(RuntimeError):
        plans.weekly_pipeline(spark, raw(10, 30), store, meta, 0, 1)
    monkeypatch.undo()
    plans.weekly_pipeline(spark, raw(20, 30, 40), store, meta, 0, 1)
    acts = sources.load_table(spark, store)
    rows = acts.select("Activity ID", "Serial").collect()
    begun = step != "serials" and (step != "-new" or after)
    assert sorted(r[0] for r in rows) == ([10, 20, 30, 40, 77] if begun else [20, 30, 40, 77])
    assert sorted(r[1] for r in rows) == list(range(1, len(rows) + 1))
    got = sources.load_table(spark, meta).first()
    assert got.total_run_km == 5.0 * (len(rows) - 1)


def test_two_pipelines_at_once_give_no_serial_twice(spark, tmp_path):
    store, meta, errors = str(tmp_path / "acts"), str(tmp_path / "meta"), []

    def work(*numbers):
        try:
            plans.weekly_pipeline(spark, spark.createDataFrame([payload(*numbers)], "`JSON Data` string, Name string"), store, meta, 0, 1)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=a) for a in ((1, 2, 3), (3, 4, 5, 6))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = sources.load_table(spark, store).select("Activity ID", "Serial").collect()
    assert not errors
    assert sorted(r[0] for r in rows) == [1, 2, 3, 4, 5, 6, 77] and sorted(r[1] for r in rows) == list(range(1, 8))
    assert sources.load_table(spark, meta).first().total_run_km == 30.0


def test_sums_of_batches_equal_a_recompute(spark, tmp_path):
    root, rng = str(tmp_path / "s"), random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 50, 51]), rng.choice(["Run", "Ride", None]), rng.choice([None, 1.5, 2.25])) for _ in range(300)]
    frame = lambda part: spark.createDataFrame(part, "athlete_id long, type string, km double")
    for i in range(6):
        for _ in range(2):  # each batch is retried
            sums.add_sums(frame(rows[50 * i : 50 * i + 50]), root, ["athlete_id", "type"], ["km"], f"b{i}")
    read = lambda **k: sums.read_sums(spark, root, ["athlete_id", "type"], ["km"], **k)
    want = sorted(map(str, sums.partial_sums(frame(rows), ["athlete_id", "type"], ["km"]).collect()))
    assert sorted(map(str, read().collect())) == want
    assert not sums.compact(spark, root, lambda at: read(version=at), "athlete_id") and sums.compact(spark, root, lambda at: read(version=at), "athlete_id", 2)
    assert sorted(map(str, read().collect())) == want and len(sources.parts(spark, root)) == 1
    some = frame([(None, "x", 0.0), (50, "x", 0.0), (99, "x", 0.0)])
    assert sorted(map(str, read(of=some).collect())) == [w for w in want if "id=None" in w or "id=50" in w]


def test_a_reader_of_one_key_leaves_most_rows_unread(spark, tmp_path):
    root = str(tmp_path / "s")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sums.add_sums(spark.range(20_000).select((F.col("id") % 5000).alias("athlete_id"), F.lit("Run").alias("type"), F.lit(1.0).alias("km")), root, ["athlete_id", "type"], ["km"], "b")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = sums.read_sums(spark, root, ["athlete_id", "type"], ["km"], of=spark.range(7, 8).select(F.col("id").alias("athlete_id")))
    assert [tuple(r) for r in one.collect()] == [(7, "Run", 4.0, 4)]
    assert rows_read(one) < 1000 < rows_read(sums.read_sums(spark, root, ["athlete_id", "type"], ["km"]))


def rows_read(df):
    """Rows that the Parquet scans of the last run of a plan gave out, after row groups were skipped."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            node = node.plan()
            name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec" and node.metrics().contains("numOutputRows"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_the_index_of_ids_reads_only_states_that_can_hold_an_id(spark, tmp_path):
    root, index = str(tmp_path / "t"), str(tmp_path / "i")
    for i in range(5):
        sources.append_table(spark.range(10_000 * i, 10_000 * i + 3000).withColumn("wide", F.lit("x")), root)
    batch = lambda numbers: spark.createDataFrame([(n,) for n in numbers], "id long")
    assert ids(sources.unseen_ids(batch([1, 20_001, 99_999, None]), root, index, "id").na.fill(-1)) == [-1, 99_999]
    known, read = sources.known_ids(batch([20_005, 20_006, 900_000]), root, index, "id")
    assert ids(known) == [20_005, 20_006] and read == ["s=000000000003"]
    assert sources.known_ids(batch([]), root, index, "id")[1] == []
    strangers = spark.range(500_000, 504_000)
    maybe = id_index.possible(strangers, root, index, "id")
    assert maybe.count() < 4000 * 5 * 0.01  # false alarms
    every = spark.range(0, 45_000)
    want = {10_000 * i + k for i in range(5) for k in range(3000)}
    assert set(ids(sources.known_ids(every, root, index, "id")[0])) == want  # no id is lost
    sources.append_table(spark.range(70_000, 70_003).withColumn("wide", F.lit("x")), root)
    with pytest.raises(ValueError, match="index"):
        sources.known_ids(every, root, index, "id")
    assert ids(sources.unseen_ids(batch([70_001, 70_005]), root, index, "id")) == [70_005]
    for kind in ("ids", "filters"):
        assert len(sources.tokens(spark, f"{index}/{kind}")) == 6
    assert sources.unseen_ids(batch([1, 2]), str(tmp_path / "none"), index, "id").count() == 2


SCHEMA = "event_id bigint, user_id bigint, ts timestamp, value double"


def run(stream, write, folder, files=None):
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination()


def stream_of(spark, folder, days):
    """One file per batch of (id, day)."""
    for i, batch in enumerate(days):
        spark.createDataFrame([(n, 1, day, 1.0) for n, day in batch], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return streaming.event_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, 1)


MARCH = dt.datetime(2024, 3, 1)


def test_an_unseen_id_arrives_however_late(spark, tmp_path):
    store = str(tmp_path / "store")
    stream = stream_of(spark, tmp_path / "in", [[(1, MARCH)], [(2, MARCH + dt.timedelta(19))], [(3, dt.datetime(2024, 1, 5)), (1, MARCH)], [(2, MARCH), (4, dt.datetime(1999, 1, 1))]])
    run(streaming.once_per_id(stream, "event_id"), streaming.append_unseen(store, "event_id", stream="a"), tmp_path / "c")
    assert ids(sources.load_table(spark, store), "event_id") == [1, 2, 3, 4]
    run(streaming.once_per_id(stream, "event_id"), streaming.append_unseen(store, "event_id", stream="b"), tmp_path / "c2")
    assert ids(sources.load_table(spark, store), "event_id") == [1, 2, 3, 4]


def test_a_stream_and_another_writer(spark, tmp_path, monkeypatch):
    """A state that comes between the comparison and the write makes the batch be compared again."""
    store = str(tmp_path / "store")
    batch = spark.createDataFrame([(1, 1, MARCH, 1.0), (2, 1, MARCH, 1.0), (None, 1, MARCH, 1.0)], SCHEMA)
    real, once = sources.unseen_ids, []

    def meanwhile(*a):
        out = real(*a)
        if not once:
            once.append(1)
            sources.append_table(batch.filter("event_id = 1"), store)
        return out

    monkeypatch.setattr(sources, "unseen_ids", meanwhile)
    streaming.append_unseen(store, "event_id", stream="a")(batch, 0)
    assert ids(sources.load_table(spark, store), "event_id") == [1, 2]
    streaming.append_unseen(store, "event_id", stream="a")(spark.createDataFrame([(9, 1, MARCH, 1.0)], SCHEMA), 0)  # the same batch, retried
    assert ids(sources.load_table(spark, store), "event_id") == [1, 2]


def test_weeks_of_a_stream_equal_those_of_a_batch_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    days = [[(i * 10 + k, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(200), hours=k)) for k in range(10)] for i in range(5)]
    stream = stream_of(spark, tmp_path / "in", days)
    write = streaming.add_weekly(str(tmp_path / "w"), "user_id", "ts", "value", "s")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    run(stream, twice, tmp_path / "c")
    whole = streaming.weekly(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in/*")), "user_id", "ts", "value")
    got = streaming.weekly_totals(spark, str(tmp_path / "w"), "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.agg(F.sum("n")).first()[0] == 50


def test_metadata_of_batches_equal_a_recompute(spark, tmp_path):
    totals, meta, rng = str(tmp_path / "t"), str(tmp_path / "m"), random.Random(2)
    rows = [(rng.randrange(6), rng.choice(["Run", "Ride", "Swim", "Other"]), rng.random() * 20, rng.random() * 90) for _ in range(200)]
    frame = lambda part: spark.createDataFrame(part, "athlete_id long, type string, km double, minutes double")
    write = streaming.refresh_metadata(totals, meta, "athlete_id", 4, "s")
    for i in range(4):
        for _ in range(2):
            write(frame(rows[50 * i : 50 * i + 50]), i)
    write(frame([(99, "Run", 1.0, 1.0)]), 4)
    want = op.training_metrics(frame([*rows, (99, "Run", 1.0, 1.0)]), 4)
    assert sorted(map(str, streaming.metadata_rows(spark, meta, "athlete_id").select(want.columns).collect())) == sorted(map(str, want.collect()))
    last = spark.read.parquet(f"{meta}/{sources.newest(spark, meta)}")
    assert [r.athlete_id for r in last.collect()] == [99]  # only the athlete of the batch


def test_new_ids_are_found_without_broadcasts(spark, tmp_path):
    root, index = str(tmp_path / "t"), str(tmp_path / "i")
    for i in range(3):
        sources.append_table(spark.range(100 * i, 100 * i + 100), root)
    batch = spark.range(250, 350)
    out = sources.unseen_ids(batch, root, index, "id")
    assert sorted(r.id for r in out.collect()) == list(range(300, 350))
    for df in (out, id_index.possible(batch, root, index, "id")):
        assert df.collect() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
