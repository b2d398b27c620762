import json
import math
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake import operators as op
from stridelake import plans, schemas, sources


def test_serial_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = op.with_serial(df, ["k"], 5).collect()
    assert sorted((r.k, r.serial) for r in got) == [(i, i + 6) for i in range(1000)]
    assert op.with_serial(df.limit(0), ["k"]).count() == 0


def test_versions_append_and_snapshot(spark, tmp_path):
    root = str(tmp_path / "t")
    sources.write_table(spark.range(3), root)
    sources.append_table(spark.range(3, 5), root)
    kept = sources.snapshot(spark, root)
    sources.append_table(spark.range(5, 6), root)
    assert sources.load_table(spark, root, kept).count() == 5
    assert sources.load_table(spark, root).count() == 6
    sources.write_table(sources.load_table(spark, root).filter("id > 4"), root)
    assert sources.load_table(spark, root).count() == 1
    sources.publish({"a": spark.range(2), "b": spark.range(1)}, root)
    log = sources.log_load({"a": sources.load_table(spark, f"{root}/a"), "b": spark.range(0)}).first()
    assert (log.a_count, log.b_count) == (2, 0)


def test_units_by_header(spark, tmp_path):
    (tmp_path / "batch_1_indiv_activities.csv").write_text("Athlete ID,Activity ID,Distance (mi),Pace (min/mi),Time\n1,10,2.0,8.0,16m 0s\n")
    (tmp_path / "batch_2_indiv_activities.csv").write_text("Athlete ID,Activity ID,Distance (km),Pace (min/km),Time\n1.0,11,5.0,4.0,20m 0s\n")
    (tmp_path / "batch_3_meta.csv").write_text("Athlete ID,Name\n1,Ada\n")
    mi, km, other = sources.read_by_unit(spark, str(tmp_path), schemas.ACTIVITIES_RAW_MI, schemas.ACTIVITIES_RAW_KM)
    assert (mi.count(), km.count(), other) == (1, 1, 1)
    both = {r["Activity ID"]: r for r in plans.unify_units(mi, km).collect()}
    assert round(both[10]["Distance (km)"], 4) == 3.2187 and both[11]["Athlete ID"] == 1
    assert both[11]["Activity Time (s)"] == 1200
    read = sources.read_dir(spark, str(tmp_path), "*_meta.csv", spark.createDataFrame([], "Name string, `Athlete ID` string").schema)
    assert tuple(read.first()) == ("Ada", "1")
    assert sources.with_batch(spark.read.option("header", True).csv(str(tmp_path / "batch_3_meta.csv"))).first()["batch"] == "3"
    assert not op.schema_accepts(["Athlete ID"], schemas.WEEKLY_TOTALS) and op.schema_accepts(schemas.WEEKLY_TOTALS.fieldNames()[::-1], schemas.WEEKLY_TOTALS)


def test_result_rows_skip_headers_and_short_rows(spark):
    html = "<table><tr><th>r</th></tr><tr><td>one</td></tr><tr><td>1</td><td>1:45.00</td><td></td><td><a>Ada RUNNER</a></td><td></td><td>USA</td><td>City (i)</td><td>08 Jun 2024</td><td></td></tr></table>"
    got = sources.extract_rows(spark.createDataFrame([(html,), (None,), ("",)], "html string"), sources.TOPLIST).collect()
    assert len(got) == 1 and got[0]["competitor"] == "Ada RUNNER" and got[0]["score"] == "" and got[0]["location"] == "City (i)"


BATCH = schemas.table_schema("Name string, km double, note string")


def test_weekly_batches_from_a_folder(spark, tmp_path):
    """JOB-8: headers in other orders, a byte order mark, quoted line breaks in a name and in a field, foreign and empty files, no number in a name."""
    (tmp_path / "batch_2_meta.csv").write_text("Name,km,note\nAda,1.5,x\nBo,2.5,y\n")
    (tmp_path / "batch_10_meta.csv").write_text('\ufeffnote,Name,km\n"two\nlines",Ada,9\nz,Cy,3\n,,4\n', encoding="utf-8")
    (tmp_path / "batch_1_meta.csv").write_text("Name,km\nAda,7\n")
    (tmp_path / "batch_3_meta.csv").write_text('"Name","km","no\nte"\nAda,7,q\n')
    (tmp_path / "old_meta.csv").write_text("km,note,Name\n5,u,Bo\n6,u,Ada\n8,u,\n")
    (tmp_path / "batch_4_meta.csv").write_text("")
    rows, rejected = plans.merge_weekly_batches(spark, str(tmp_path), BATCH, "*_meta.csv")
    assert rejected == ["batch_1_meta.csv", "batch_3_meta.csv", "batch_4_meta.csv"]
    # Bo is in one numbered batch and keeps the row without one; rows without a name stay
    assert sorted(map(str, map(tuple, rows.select("Name", "km", "batch").collect()))) == sorted(map(str, [("Ada", 1.5, "2"), ("Bo", 2.5, "2"), ("Cy", 3.0, "10"), (None, 4.0, "10"), ("Bo", 5.0, "Unknown"), (None, 8.0, "Unknown")]))
    both = {r.name: (r.batch, r.header) for r in sources.file_table(spark, f"{tmp_path}/*_meta.csv").collect()}
    assert both["batch_3_meta.csv"] == ("3", ["Name", "km", "no\nte"]) and both["old_meta.csv"][0] == "Unknown" and both["batch_10_meta.csv"][1][0] == "note"
    assert sources.file_table(spark, f"{tmp_path}/none*.csv").count() == 0 and sources.read_dir(spark, str(tmp_path), "none*", BATCH, "f").columns[-1] == "f"


def test_a_header_longer_than_the_first_bytes(spark, tmp_path):
    names = [f"column {i} of a very long header" for i in range(5000)]
    (tmp_path / "wide file.csv").write_text(",".join([*names, "Name"]) + "\n" + "," * 5000 + "Ada\n")
    assert sources.headers(spark, f"{tmp_path}/*.csv").popitem()[1] == [*names, "Name"]
    assert [tuple(r) for r in sources.read_dir(spark, str(tmp_path), "*.csv", BATCH).collect()] == [("Ada", None, None)]


def test_files_without_quoted_breaks_are_read_in_splits(spark, tmp_path):
    """A file of many splits is read by as many tasks unless some field of it goes over a line."""
    text = "Name,km,note\n" + "".join(f'N{i},{i},"a ""b"" c"\n' for i in range(20_000))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text(text + 'Z,1,"two\nlines"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split, whole = (sources.read_dir(spark, str(tmp_path), f"{n}.csv", BATCH) for n in "ab")
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert (split.count(), whole.count()) == (20_000, 20_001) and split.agg({"km": "sum"}).first()[0] == sum(range(20_000))
        assert sources.read_dir(spark, str(tmp_path), "a.csv", BATCH, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metadata_from_raw_tables(spark):
    """JOB-7: names in several spellings are one athlete on both sides, times of any zone, seconds or elapsed seconds, what is null is reported."""
    raw = spark.createDataFrame([(" ada  o'NEIL", "2024-01-02T23:30:00Z", "Run", "10.0", "3600", "9"), ("Ada O'Neil", "2024-01-03T01:00:00+09:00", "VirtualRide", None, None, "1800"), ("Bo", "2024-01-20T00:00:00Z", "Run", "1", "1", "1"), ("Bo", "2024-01-08T00:00:00Z", "Yoga", "x", "", "7200"), ("Cy", "soon", "Run", "1", "1", "1")], "`Athlete Name` string, `Start Date` string, Type string, `Distance (km)` string, `Activity Time (s)` string, `Elapsed Time` string")
    perf = spark.createDataFrame([("ADA O'NEIL", "USA", "F", "1:45", "800 m", 2), ("Ada  o'neil ", "USA", "F", "3:30", "1500 m", 1), ("DEE", "GBR", "F", "9.9", "100 m", 3)], "Competitor string, Nat string, Gender string, Mark string, Discipline string, seq int")
    out, nulls = plans.metadata_from_raw(raw, perf, "2024-01-01", 2, "seq")
    got = {r.athlete: r for r in out.collect()}
    assert sorted(got) == ["Ada O'Neil", "Bo"]
    ada, bo = got["Ada O'Neil"], got["Bo"]
    assert (ada.total_run_km, ada.avg_weekly_run_km, ada.total_run_hours, ada.total_ride_hours, ada.marks, ada.disciplines, ada.n_events, ada.nat) == (10.0, 5.0, 1.0, 0.5, "3:30|1:45", "1500 m|800 m", 2, "USA")
    assert (bo.total_run_km, bo.total_other_hours, bo.marks, bo.nat, bo.n_events) == (0.0, 2.0, "", "", 0)
    assert [tuple(r) for r in nulls.collect()] == [("avg_run_pace", 1)]


def test_medians_of_long_groups(spark):
    """Equal to ``percentile`` without a buffer above ``longest``: ties, two heavy values around the middle, doubles of all magnitudes, odd and even, null keys."""
    n = F.col("id")
    parts = [
        spark.range(1_000_000).select(F.lit("many").alias("k"), (n * 7919 % 1_000_003).cast("double").alias("v")),
        spark.range(60_001).select(F.lit("odd"), F.pow(F.lit(10.0), (n % 600) - 300)),
        spark.range(60_000).select(F.lit("two"), F.when(n % 2 == 0, 5.0).otherwise(6.0)),
        spark.range(50_000).select(F.lit("one"), F.lit(-1.5)),
        spark.range(40_000).select(F.lit(None).cast("string"), F.when(n % 3 > 0, F.xxhash64("id").cast("double"))),
        spark.range(7).select(F.lit("short"), n.cast("double")),
        spark.range(3).select(F.lit("null"), F.lit(None).cast("double")),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    got = {r.k: r.median for r in op.exact_medians(df, ["k"], "v", longest=1000).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert got == want and got["two"] == 5.5 and got["null"] is None and len(got) == 7
    assert {r.k: r.median for r in op.exact_medians(df.filter("k in ('short', 'null')"), ["k"], "v", longest=1000).collect()} == {"short": 3.0, "null": None}


@pytest.mark.parametrize("text", ["ana", "ANA", "nan", "é b", "an", "", "anana", "zzz", "İa", "%_x", "a a"])
def test_the_name_index_equals_the_scan(spark, tmp_path, text):
    names = ["Banana", "ananas", "ANAN", "Ana", "an", "", None, "Bané b", "BANÉ B", "İAn", "nan anan", "Hanna Na", "x%_x", "a a a", *[f"Anan {i}" for i in range(30)]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    root = str(tmp_path / "i")
    for part in (df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), df.filter("id % 2 = 1")):
        sources.add_names(part, root, "name", "id", token=f"b{part.first().id}")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(sources.search_indexed(df, root, "name", "id", text)) == ids(op.search_names(df, "name", text, 10, "id"))


def test_lists_per_place_are_bounded(spark):
    rows = [(1.0, None, f"n{i:04d}") for i in range(500)] + [(2.0, 3.0, None), (None, None, "z"), (2.0, 3.0, "y"), (4.0, 4.0, None)]
    df = spark.createDataFrame(rows, "lat double, lng double, name string").repartition(8)
    got = {(r.lat, r.lng): (r.n, r.names) for r in op.athletes_by_location(df, "lat", "lng", "name", 3).collect()}
    assert got == {(1.0, None): (500, ["n0000", "n0001", "n0002"]), (2.0, 3.0): (2, ["y"]), (None, None): (1, ["z"]), (4.0, 4.0): (1, [])}
    plan = op.athletes_by_location(df, "lat", "lng", "name", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan
    places = op.location_members(df, "lat", "lng", "name").filter("lat = 1").collect()
    assert sorted((r.place, r.name) for r in places) == [(i + 1, f"n{i:04d}") for i in range(500)]


@pytest.mark.parametrize("order", ["by_score", "by_name", "newest_first"])
def test_rows_come_in_order(spark, order):
    df = spark.createDataFrame([("b", 2, 3.0), ("a", 5, None), ("b", 1, 9.0), ("c", 9, 9.0)], "name string, d int, score double").repartition(3)
    found = {"by_score": lambda: op.by_score(df, "score", "d"), "by_name": lambda: op.by_name(df, "name", "d"), "newest_first": lambda: op.newest_first(df, "d")}[order]().collect()
    assert [r.d for r in found] == {"by_score": [1, 9, 2, 5], "by_name": [5, 1, 2, 9], "newest_first": [9, 5, 2, 1]}[order]


def test_golden_filters(spark):
    rows = [("City A",), ("City B (i)",), ("City C",)]
    assert op.outdoor_only(spark.createDataFrame(rows, "location string")).count() == 2
    six = [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 1)]
    assert op.repeated(spark.createDataFrame(six, "k string, v int"), ["k"]).count() == 4


def test_groups_of_equal_weeks_are_ranked_by_their_key(spark):
    # the same weeks in another order for each key, so that sums of doubles differ in their last bits
    weeks = [12.34, 7.1, 0.1, 33.3, 41.07, 5.0, 19.99, 28.6, 0.0, 3.3, 47.2]
    rows = [(k, weeks[(i * (k % 10 + 1) + k) % 11]) for k in range(40) for i in range(11)]
    ranking = plans.consistency_ranking(spark.createDataFrame(rows, "k int, km double").repartition(7), "k", "km").collect()
    assert len({(r.std_dev, r.median_to_mean) for r in ranking}) == 1 and all(r.serial == r.k + 1 for r in ranking)
    assert ranking[0].std_dev == pytest.approx(statistics.stdev(w for w in weeks if w))


def test_spread_of_values_that_no_decimal_holds(spark):
    values = {"tiny": [1e-9, 3e-9], "huge": [1e30, 3e30], "long": [1 / 3, 2 / 3], "one": [5.0], "many": [9e11] * 3 + [1e11], "odd": [float("inf"), 1.0]}
    out = {r.k: r for r in op.consistency(spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, km double"), "k", "km").collect()}
    for k in ("tiny", "huge", "long", "many"):
        assert out[k].std_dev == pytest.approx(statistics.stdev(values[k])) and out[k].median_to_mean == pytest.approx(statistics.median(values[k]) / statistics.mean(values[k]))
    assert out["one"].std_dev is None and math.isnan(out["odd"].std_dev)


def test_consistency_without_valid_weeks(spark):
    r = op.consistency(spark.createDataFrame([("a", 0.0), ("a", None), ("b", 5.0)], "k string, km double"), "k", "km")
    got = {x.k: x for x in r.collect()}
    assert got["a"].std_dev == float("inf") and got["a"].no_data == 2 and got["b"].std_dev is None and got["b"].median_to_mean == 1


def payload(*ids, name="Ada"):
    entries = [{"activity": {"id": i, "activityName": "<b>Run</b>", "startDate": "2024-11-10T10:00:00Z", "elapsedTime": 60, "type": "Run", "athlete": {"athleteId": 1, "athleteName": "ADA "}, "stats": [{"key": "stat_one", "value": "5.0 km"}, {"key": "stat_two", "value": "4:30 /km"}, {"key": "stat_three", "value": "22m 30s"}]}} for i in ids]
    group = {"rowData": {"activities": [{"activity_id": 77, "athlete_id": 1, "athlete_name": "ada", "type": "Ride", "stats": []}, {"activity_id": 78, "athlete_id": 2, "athlete_name": "Bo", "stats": []}]}}
    return (json.dumps({"appContext": {"preFetchedEntries": [*entries, group]}}), name)


def test_weekly_pipeline_is_idempotent(spark, tmp_path):
    raw = spark.createDataFrame([payload(10, 11, 10), ("{broken", "Ada")], "`JSON Data` string, Name string")
    flat, bad = plans.flatten_payloads(raw)
    assert sorted(r.activity_id for r in flat.collect()) == [10, 11, 77] and bad.count() == 1
    store, meta = str(tmp_path / "acts"), str(tmp_path / "meta")
    plans.weekly_pipeline(spark, raw, store, meta, 0, 2).collect()
    before = sources.load_table(spark, meta).first()
    plans.weekly_pipeline(spark, raw, store, meta, 2, 3).collect()
    acts = sources.load_table(spark, store)
    assert sorted(acts.select("Serial").toPandas()["Serial"]) == [1, 2, 3]
    after = sources.load_table(spark, meta).first()
    assert (after.total_run_km, after.avg_weekly_run_km, after.weeks) == (before.total_run_km, before.avg_weekly_run_km, before.weeks) == (10.0, 5.0, 2)


def test_weekly_pipeline_makes_up_for_a_crash(spark, tmp_path, monkeypatch):
    store, meta = str(tmp_path / "acts"), str(tmp_path / "meta")
    raw = spark.createDataFrame([payload(10)], "`JSON Data` string, Name string")
    plans.weekly_pipeline(spark, raw, store, meta, 0, 1).collect()
    more = spark.createDataFrame([payload(10, 11)], "`JSON Data` string, Name string")
    whole = sources.write_table

    def broken(df, root, **more):
        if root == meta:
            raise RuntimeError("lost")
        return whole(df, root, **more)

    monkeypatch.setattr(sources, "write_table", broken)
    with pytest.raises(RuntimeError):
        plans.weekly_pipeline(spark, more, store, meta, 1, 2)
    monkeypatch.undo()
    plans.weekly_pipeline(spark, more, store, meta, 1, 2).collect()
    assert sources.load_table(spark, store).count() == 3
    got = sources.load_table(spark, meta).first()
    assert (got.total_run_km, got.weeks) == (10.0, 2)


def test_ingest_drops_null_ids_and_picks_alike(spark):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x")], "id long, batch string")
    known = spark.createDataFrame([(None,), (5,)], "id long")
    assert [tuple(r) for r in plans.ingest_activities(new, known, "id").collect()] == [(1, "a")]
    old = spark.createDataFrame([(1, 1200.0)], "id long, score double")
    many = spark.createDataFrame([(1, 1300.0), (2, 1150.0), (2, 1150.0), (3, 900.0)], "id long, score double")
    assert [r.id for r in plans.update_results(old, many, ["id"], "score", 1100).collect()] == [1, 2]


def test_serials_and_ranks_of_many_wide_rows(spark):
    """Enough rows for sampled ranges and adaptive coalescing to differ between two plans of the same exchange."""
    n = 500_000
    df = spark.range(n, numPartitions=64).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    try:
        wrong = op.with_serial(df, ["k"], 5).agg(F.count_if(F.col("serial") != F.col("k") + 6).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
        assert (wrong.wrong, wrong.n) == (0, n)
        ranked = op.with_rank(df, ["g"], [F.desc("k")])
        want = df.select("g", "k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("k"))).alias("want"))
        both = ranked.join(want, ["g", "k"]).agg(F.count_if(F.col("rank") != F.col("want")).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
        assert (both.wrong, both.n) == (0, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_by_name_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Athlete ID,Description\n"Ada",1,"two\nlines, ""quoted"""\n')
    (tmp_path / "b.csv").write_text("Athlete ID,Description,Name\nx,plain,Bo\n")
    (tmp_path / "empty.csv").write_text("")
    got = sources.read_dir(spark, str(tmp_path), "*.csv", schemas.table_schema("`Athlete ID` bigint, Name string, Description string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(1, "Ada", 'two\nlines, "quoted"'), (None, "Bo", "plain")]


def test_entries_of_both_kinds_from_one_parse(spark, tmp_path):
    act = {"id": 5, "activityName": "Run", "athlete": {"athleteId": 1, "athleteName": "Ada"}, "stats": [{"key": "stat_one", "value": "5 km"}]}
    group = {"activities": [{"activity_id": 6, "athlete_id": 1, "name": "Ride", "stats": None}, None, {"activity_id": 7}]}
    entries = [{"activity": act, "rowData": group, "timeAndLocation": {"location": "here"}}, {"rowData": {"activities": None}}, {}, {"activity": act}]
    path = str(tmp_path / "raw")
    spark.createDataFrame([(json.dumps({"preFetchedEntries": entries}), 9)], "p string, key int").write.parquet(path)
    good, _ = sources.parse_payload(spark.read.parquet(path), "p", schemas.PAYLOAD)
    out = plans.explode_entries(good, ["key"])
    got = sorted((r.key, r.entry_pos, r.row_pos, r.activity_id or 0, r.location or "", str(r.stats)) for r in out.collect())
    stats = str({"stat_one": "5 km"})
    assert got == sorted([(9, 0, 0, 5, "here", stats), (9, 0, 0, 6, "here", "None"), (9, 0, 1, 0, "here", "None"), (9, 0, 2, 7, "here", "None"), (9, 3, 0, 5, "", stats)])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
