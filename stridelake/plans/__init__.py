"""Composite jobs JOB-1 to JOB-20: DataFrames in, DataFrames out; only the weekly pipeline and the update of the results table write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import operators as op
from .. import schemas, sources
from ..sources import sums
from ..storage import discard, stored


def payload_root(payload: str = "payload") -> Column:
    """PRJ-10."""
    return F.coalesce(F.col(f"{payload}.preFetchedEntries"), F.col(f"{payload}.appContext.preFetchedEntries"))


def explode_entries(df: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """PRJ-9: individual and group activities of every entry, statistics as a map."""
    e = "e" + uuid.uuid4().hex  # no column of ``keep`` has this name
    entries = df.select(*keep, F.posexplode(payload_root(payload)).alias("entry_pos", e))
    stats = lambda c: F.map_from_entries(F.transform(c, lambda s: F.struct(s["key"], s["value"])))
    fields = lambda pos, **columns: F.struct(pos.cast("int").alias("row_pos"), *[c.alias(k) for k, c in columns.items()])
    x = F.col(e)
    act, place = x["activity"], x["timeAndLocation"]["location"]
    one = fields(
        F.lit(0), athlete_id=act["athlete"]["athleteId"].cast("bigint"), athlete_name=act["athlete"]["athleteName"], activity_id=act["id"], activity_name=act["activityName"], description=act["description"], start_date=act["startDate"], elapsed_time=act["elapsedTime"], type=act["type"],
        location=F.coalesce(act["timeAndLocation"]["location"], place), stats=act["stats"])
    group = lambda a, i: fields(
        i, athlete_id=a["athlete_id"], athlete_name=a["athlete_name"], activity_id=a["activity_id"], activity_name=a["name"], description=a["description"], start_date=a["start_date"], elapsed_time=a["elapsed_time"], type=a["type"], location=place, stats=a["stats"])
    # one list of both kinds, so that a payload is parsed once
    rows = F.concat(F.filter(F.array(one), lambda _: act.isNotNull()), F.coalesce(F.transform(x["rowData"]["activities"], group), F.array()))
    flat = entries.select(*keep, "entry_pos", F.explode(rows).alias(e))
    names = ["row_pos", "athlete_id", "athlete_name", "activity_id", "activity_name", "description", "start_date", "elapsed_time", "type", "location"]
    return flat.select(*keep, "entry_pos", *[x[n].alias(n) for n in names], stats(x["stats"]).alias("stats"))


def flatten_payloads(raw: DataFrame, json: str = "JSON Data", target: str = "Name") -> tuple[DataFrame, DataFrame]:
    """JOB-1: activities of each payload's own athlete, once per id; and the unreadable payloads."""
    good, bad = sources.parse_payload(raw.withColumnRenamed(target, "target_name"), json, schemas.PAYLOAD)
    flat = op.match_target(explode_entries(good, ["target_name"]), "athlete_name", "target_name")
    flat = op.dedupe_ids(flat, "activity_id", ["entry_pos", "row_pos"])
    text = lambda k: fn.html_to_text(F.col("stats")[k])
    return flat.select("athlete_id", "athlete_name", "activity_id", fn.html_to_text(F.col("activity_name")).alias("activity_name"), fn.html_to_text(F.col("description")).alias("description"), fn.parse_instant(F.col("start_date")).alias("start_date"), "elapsed_time", "type", "location", fn.first_number(text("stat_one")).alias("distance_km"), fn.parse_pace(text("stat_two")).alias("pace_min_km"), text("stat_three").alias("time")), bad


def clean_activities(raw: DataFrame, start_serial: int = 0) -> DataFrame:
    """JOB-2: the stored activity table from raw km rows (columns as in schemas.ACTIVITIES_RAW_KM)."""
    minutes = fn.parse_duration_min(F.col("Time"))
    km = fn.to_number(F.col("`Distance (km)`"), default=0.0)
    out = raw.withColumn("Athlete Name", fn.display_name(F.col("`Athlete Name`"))).withColumn("Time (min)", minutes).withColumn("Distance (km)", km).withColumn("Activity Time (s)", fn.seconds(minutes))
    out = out.withColumn("Pace (min/km)", F.coalesce(fn.pace(F.col("`Time (min)`"), F.col("`Distance (km)`")), F.lit(0.0))).withColumn("Pace (min/mi)", F.lit(None).cast("double"))
    return op.conform(op.with_serial(out, ["Activity ID"], start_serial, "Serial"), schemas.ACTIVITIES)


def ingest_activities(new: DataFrame, known: DataFrame, id_col: str = "Activity ID", order: list | None = None) -> DataFrame:
    """JOB-3: the rows to append; running it twice adds nothing. Rows without an id are left out; of rows with the same id the
    first in ``order`` counts (by default that of all columns, so that the choice never changes)."""
    return op.unseen(once_per_activity(new, id_col, order), known.select(id_col), [id_col])


def once_per_activity(new: DataFrame, id_col: str = "Activity ID", order: list | None = None) -> DataFrame:
    """JOB-3 before the comparison with what is stored: the first row of each id, none without an id."""
    return op.first_per(new.filter(F.col(f"`{id_col}`").isNotNull()), [id_col], order or [F.col(f"`{c}`") for c in new.columns])


def unify_units(miles: DataFrame, km: DataFrame) -> DataFrame:
    """JOB-6: rows in miles converted, both stacked with minutes and whole seconds."""
    converted = miles.withColumn("Distance (km)", fn.mi_to_km(F.col("`Distance (mi)`"))).withColumn("Pace (min/km)", fn.pace_mi_to_km(F.col("`Pace (min/mi)`"))).drop("Distance (mi)", "Pace (min/mi)")
    both = op.stack(km, converted, allow_missing=True).withColumn("Time (min)", fn.parse_duration_min(F.col("Time")))
    return both.withColumn("Activity Time (s)", fn.seconds(F.col("`Time (min)`"), legacy=True))


def metadata_from_raw(raw: DataFrame, perf: DataFrame, start: str, weeks: int, seq: str) -> tuple[DataFrame, DataFrame]:
    """JOB-7 from raw tables: the metadata of every athlete, and the report of nulls that are left in it.

    ``raw``: Athlete Name, Start Date, Type, Distance (km), Activity Time (s), Elapsed Time, texts or numbers as they come. ``perf``: Competitor, Nat,
    Gender, Mark, Discipline and ``seq``, the order of its rows. Names are brought to one form on both sides (FN-8) before anything is grouped by them, times read
    (FN-17) and cut to the weeks (FLT-4), types put into four kinds (FN-15) and seconds into hours (FN-16); metrics (AGG-1 to AGG-3) are joined to the summary of
    results (AGG-4, JN-1), filled (PRJ-11) and checked (QLT-1).
    """
    number = lambda c: fn.to_number(F.col(f"`{c}`").cast("string"))
    acts = raw.select(
        fn.display_name(F.col("`Athlete Name`")).alias("athlete"), fn.parse_instant(F.col("`Start Date`").cast("string")).alias("ts"), fn.activity_type(F.col("Type")).alias("type"),
        number("Distance (km)").alias("km"), (fn.hours(number("Activity Time (s)"), number("Elapsed Time")) * 60).alias("minutes"))
    metrics = op.training_metrics(op.in_weeks(acts, "ts", start, weeks), weeks, None, athlete="athlete")
    results = op.summarise_results(perf.withColumn("athlete", fn.display_name(F.col("Competitor"))), "athlete", "Nat", "Gender", "Mark", "Discipline", seq)
    out = op.export_fill(op.attach_results(metrics, results, "athlete"), {"nat": "", "gender": "", "marks": "", "disciplines": "", "n_events": 0})
    return out, op.null_profile(out)


def build_metadata(activities: DataFrame, results: DataFrame, start: str, weeks: int) -> DataFrame:
    """JOB-7 from cleaned activities: training metrics of every athlete with the summary of their results. Activities: athlete, ts, type, km, minutes; results by athlete."""
    inside = op.in_weeks(activities, "ts", start, weeks).withColumn("type", fn.activity_type(F.col("type")))
    metrics = op.training_metrics(inside, weeks, None, athlete="athlete")
    return op.export_fill(op.attach_results(metrics, results, "athlete"), {"marks": "", "disciplines": "", "n_events": 0})


def update_metadata(old: DataFrame, metrics: DataFrame, start_week: int, end_week: int) -> DataFrame:
    """JOB-5: new metrics over old ones; the weeks from ``start_week`` to ``end_week`` are added where there are new metrics, and nowhere else."""
    columns = [c for c in metrics.columns if c != "athlete_id" and c in old.columns]
    added = metrics.select("athlete_id", *columns, F.lit(end_week - start_week).alias("__more"))
    out = op.update_from(old.withColumn("__more", F.lit(0)), added, "athlete_id", [*columns, "__more"])
    return out.withColumn("weeks", F.col("weeks") + F.col("__more")).drop("__more")


def merge_weekly_batches(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.csv", name: str = "Name", multi_line: bool | None = None) -> tuple[DataFrame, list[str]]:
    """JOB-8: from a folder of weekly files the rows of each name's first batch, with ``batch``, and the names of the files that were left out.

    Files with the contract's columns in any order are stacked, others left out (SRC-2, QLT-3, SET-1); a row's batch is the number in its file's name
    (SRC-3), and batches are compared as numbers (WIN-3, also on rows of files without one).
    """
    rows, rejected = sources.accepted_files(spark, folder, glob, schema, "__file", multi_line)
    rows = sources.with_batch(rows, "__file").withColumn("__order", F.col("batch").try_cast("long"))
    return op.earliest_batch(rows, name, "__order").drop("__order"), rejected


def consistency_ranking(weekly: DataFrame, key: str, value: str) -> DataFrame:
    """JOB-9: consistency statistics with their place in the order (consistency down, spread up, missing weeks up)."""
    stats = op.consistency(weekly, key, value)
    stats = stats.withColumn("__c", -F.col("consistency_pct")).withColumn("__s", F.coalesce("std_dev", F.lit(float("inf"))))
    return op.with_serial(stats, ["__c", "__s", "no_data", key]).drop("__c", "__s")


def consistency_report(weekly: DataFrame, key: str, value: str, then: str) -> tuple[DataFrame, DataFrame]:
    """JOB-9 in full: the ranking (AGG-7, ORD-1), and the weekly rows in its order (ORD-2), those of one athlete by ``then``."""
    ranking = consistency_ranking(weekly, key, value)
    return ranking, op.order_like(weekly, ranking, key, then)


def new_results(old: DataFrame, new: DataFrame, keys: list[str], score: str, cutoff: float) -> DataFrame:
    """JOB-10: the new results with a score from the cutoff on whose performance (FN-21) is not stored, each performance once (that of the highest score)."""
    key = fn.performance_key(*[F.col(k) for k in keys])
    rows = op.min_score(new, score, cutoff).withColumn("__key", key)
    rows = op.first_per(rows, ["__key"], [F.desc(score), *new.columns])
    return op.unseen(rows, old.select(key.alias("__key")), ["__key"]).drop("__key")


def update_results(old: DataFrame, new: DataFrame, keys: list[str], score: str, cutoff: float) -> DataFrame:
    """JOB-10: stored results that have a score, and the new ones, highest score first."""
    return op.by_score(op.stack(op.require(old, score), new_results(old, new, keys, score, cutoff)), score, *keys)


def update_results_table(spark: SparkSession, root: str, new: DataFrame, keys: list[str], score: str, cutoff: float, created: str, by: str) -> tuple[str, DataFrame]:
    """JOB-10 on a stored table: the state before the change (SNK-3), and how many results were added by ``by`` (AGG-8). A second run adds none."""
    before = sources.snapshot(spark, root)
    old = sources.load_table(spark, root, before)
    version = sources.append_table(new_results(old, op.with_literals(new, Date_Created=created), keys, score, cutoff), root)
    return before, op.value_counts(spark.read.parquet(f"{root}/{version}"), by)


def link_results_to_athletes(results: DataFrame, metas: list[DataFrame], key: str, seq: str, values: list[str], created: str, today, fills: dict | None = None) -> DataFrame:
    """JOB-11: values of each competitor's first row in the stacked metadata (``seq`` orders the rows of a table, tables in the given order)."""
    meta = op.stack(*[m.withColumn("__table", F.lit(i)) for i, m in enumerate(metas)])
    first = op.first_per(meta, [key], ["__table", seq])
    out = op.link_first_match(results, first, key, seq, values, created, today)
    return op.export_fill(out, fills) if fills else out


def assign_athlete_ids(meta: DataFrame, mapping: DataFrame, name: str, id_col: str, seq: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB-12: the table with ``assigned_id`` (0 if unknown), the unmatched names with their number of rows, and the match statistics."""
    known = mapping.filter(F.col(id_col).isNotNull())
    out, _ = op.assign_ids(meta, known, name, id_col, seq)
    keyed = lambda df: df.withColumn("match_key", fn.match_key(F.col(name)))
    return out, op.unmatched_report(keyed(meta), keyed(known), "match_key"), op.match_stats(out, "assigned_id")


def form_scores(perf: DataFrame, roster: DataFrame, reference: str = "2024-08-01", lam: float = 0.001) -> DataFrame:
    """JOB-13: perf (athlete, discipline, location, day, score), roster (athlete, event): decayed score of each entrant's latest outdoor result."""
    known = op.latest_struct(op.before(op.outdoor_only(perf.withColumn("athlete", F.upper("athlete"))), "day", reference), ["athlete", "discipline"], F.struct("day", "score"))
    entered = op.events_per_athlete(roster.withColumn("athlete", fn.flip_name(F.col("athlete"))), "athlete", "event")
    out = known.join(entered, "athlete")
    days = fn.days_since(F.col("day").cast("date"), reference)
    return out.withColumn("days", days).withColumn("weighted_score", fn.decayed(F.col("score"), days, lam))


def form_table(perfs: list[DataFrame], roster: DataFrame, reference: str = "2024-08-01", lam: float = 0.001) -> DataFrame:
    """JOB-13 in full: the result lists of several disciplines stacked (SET-1), scored (``form_scores``) and the best form first (ORD-3)."""
    return op.by_score(form_scores(op.stack(*perfs), roster, reference, lam), "weighted_score", "athlete", "discipline")


def evaluate_predictions(final: DataFrame, predictions: DataFrame, null_policy: str = "none") -> DataFrame:
    """JOB-14: final (event, athlete, place), predictions (predictor, event, athlete, score): error of each predictor's ranks.

    Finalists a predictor did not rank (FN-30): left out (``none``), no error (``zero``), or the mean error (``mean``, which leaves the means as they are and counts them).
    """
    ranked = op.with_rank(predictions, ["predictor", "event"], [F.desc("score"), "athlete"])
    ranked = ranked.groupBy("predictor", "event", "athlete").agg(F.min("rank").alias("rank"))
    if null_policy == "none":
        return op.rank_error(final.join(ranked, ["event", "athlete"]), ["predictor", "event"], "rank", "place")
    asked = final.join(ranked.select("predictor", "event").distinct(), "event").join(ranked, ["predictor", "event", "athlete"], "left")
    square = F.pow(fn.rank_delta(F.col("rank"), F.col("place"), "zero" if null_policy == "zero" else "none"), F.lit(2))
    return asked.groupBy("predictor", "event").agg(F.avg(square).alias("mse"), F.sqrt(F.avg(square)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def prediction_scoreboard(errors: DataFrame, one: str, other: str) -> DataFrame:
    """JOB-14: the root mean squared errors of two predictors side by side, event by event (JN-4)."""
    side = lambda name: errors.filter(F.col("predictor") == name).select("event", F.col("rmse").alias(f"rmse_{name}"))
    return op.compare_scoreboards(side(one), side(other))


def compare_predictors(final: DataFrame, one: DataFrame, other: DataFrame, names: tuple[str, str], null_policy: str = "none") -> DataFrame:
    """JOB-14 in full: two predictors' scores (event, athlete, score) against the same final (event, athlete, place), the errors of their ranks side by side, event by
    event; an event that one of them left out keeps the other's error."""
    both = op.stack(*[df.select(F.lit(name).alias("predictor"), "event", "athlete", "score") for name, df in zip(names, (one, other), strict=True)])
    return prediction_scoreboard(evaluate_predictions(final, both, null_policy), *names)


def multi_discipline_report(perf: DataFrame, athlete: str, discipline: str, score: str) -> DataFrame:
    """JOB-15."""
    many = op.multi_discipline(perf, athlete, discipline, score)
    return many.join(op.best_discipline(perf, athlete, discipline, score), athlete)


def combined_disciplines(perfs: list[DataFrame], athlete: str, discipline: str, score: str) -> tuple[DataFrame, DataFrame]:
    """JOB-15 in full: the result lists of several disciplines stacked (SET-1), all rows of athletes with more than one by name and discipline (WIN-4, ORD-4), and their
    report (AGG-9, AGG-10), highest mean score first (ORD-3). Scores that are no numbers count as rows but not in means and sums."""
    again = op.repeated(op.stack(*perfs, allow_missing=True), [athlete])
    numbers = again.withColumn(score, fn.to_number(F.col(score).cast("string")))
    return op.by_name(again, athlete, discipline), op.by_score(multi_discipline_report(numbers, athlete, discipline, score), "mean_score", athlete)


def recollection_plan(meta: DataFrame, state: str, value, id_col: str, size: int = 60) -> DataFrame:
    """JOB-19."""
    return op.chunk_ids(op.where_state(meta, state, value), id_col, size)


def country_report(results: DataFrame, coords: DataFrame, nat: str = "nat") -> DataFrame:
    """JOB-16: number of results of each nation that has coordinates, with them."""
    return op.with_coordinates(op.value_counts(results, nat), coords, nat, "inner")


def country_map(results: DataFrame, coords: DataFrame, nat: str, lat: str, lng: str, name: str, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """JOB-16 in full: ``country_report``, and for the map the number and first names of the athletes at each coordinate (AGG-16), each athlete once."""
    athletes = op.with_coordinates(results.select(nat, name).distinct(), coords, nat, "inner")
    return country_report(results, coords, nat), op.athletes_by_location(athletes, lat, lng, name, most)


def serve_home(athletes: DataFrame, coords: DataFrame, log: DataFrame, nat: str = "nat", ts: str = "timestamp") -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB-17: athletes with their nation's coordinates (null if unknown), the headline counts, and the latest load with its time as text."""
    latest = op.latest_row(log, ts).withColumn("last_updated", F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" (GMT +8)")))
    return op.with_coordinates(athletes, coords, nat), op.headline_counts(athletes, nat), latest


def serve_athlete(activities: DataFrame, name_col: str, name: str, ts: str) -> DataFrame:
    """JOB-18: one athlete's activities, newest first."""
    return op.newest_first(op.find_by_name(activities, name_col, name), ts)


def athlete_page(meta: DataFrame, activities: DataFrame, name_col: str, name: str, ts: str, km: str = "km", marks: str = "marks", disciplines: str = "disciplines") -> tuple[DataFrame, DataFrame]:
    """JOB-18: the athlete's row with ``event_times`` (disciplines and marks side by side), and the activities, newest first, with time and distance as text."""
    found = op.find_by_name(meta, name_col, name)
    listed = fn.not_blank(F.col(marks)) & fn.not_blank(F.col(disciplines))
    pairs = F.when(listed, fn.zip_lists(F.col(disciplines), F.col(marks)))
    profile = found.withColumn("event_times", F.coalesce(F.transform(pairs, lambda p: F.struct(p["a"].alias("discipline"), p["b"].alias("mark"))), F.array().cast("array<struct<discipline:string,mark:string>>")))
    shown = serve_athlete(activities, name_col, name, ts)
    return profile, shown.withColumn("start_text", fn.human_date(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))).withColumn("km_text", fn.fixed(F.col(km).cast("double"), 2))


def _settle(spark: SparkSession, store: str) -> None:
    """Every batch that is written becomes rows of the store and of the athletes' sums, each batch once."""
    batches, totals = f"{store}-new", f"{store}-sums"
    stored_in, summed_in = sources.tokens(spark, store), sources.tokens(spark, totals)
    for version in sources.versions(spark, batches):
        if version not in stored_in:
            sources.append_table(spark.read.parquet(f"{batches}/{version}"), store, token=version)
        if version not in summed_in:
            rows = spark.read.parquet(f"{batches}/{version}")
            rows = rows.select(F.col("`Athlete ID`").alias("athlete_id"), fn.activity_type(F.col("Type")).alias("type"), F.col("`Distance (km)`").alias("km"), F.col("`Time (min)`").alias("minutes"))
            sums.add_sums(rows, totals, _SUM_KEYS, _SUMS, version)


_SUM_KEYS, _SUMS = ["athlete_id", "type"], ["km", "minutes"]


def weekly_pipeline(spark: SparkSession, raw: DataFrame, store: str, metadata: str, start_week: int, end_week: int) -> DataFrame:
    """JOB-20: payloads to stored activities to metadata; returns the number of new rows per athlete.

    New rows become a batch of their own (``store``-new), whose serials are reserved in a ledger (``store``-serials) before it is
    written, and the batch becomes rows of the store and of the athletes' sums (``store``-sums). Each step is done once per batch, and a run first does what an
    earlier one left undone, so serials stay unique and gapless whatever step a run breaks at and whatever rows the next one brings; of two runs at once
    one gives way and begins again. Which activities are new is asked of an index of ids (``store``-index), and metrics are
    those of the sums of the athletes in the batch, per week up to ``end_week``: no stored activity is read again. The
    metadata say up to which batch they go (``upto``); a run without new rows changes no athlete.
    """
    flat, _ = flatten_payloads(raw)
    names = {"athlete_id": "Athlete ID", "athlete_name": "Athlete Name", "activity_id": "Activity ID", "activity_name": "Activity Name", "description": "Description", "start_date": "Start Date", "elapsed_time": "Elapsed Time", "type": "Type", "location": "Location", "distance_km": "Distance (km)", "pace_min_km": "Pace (min/km)", "time": "Time"}
    batches = f"{store}-new"
    # payloads are read once, however often their rows are asked below
    rows = stored(once_per_activity(flat.withColumnsRenamed(names)), "payloads")
    while True:
        at, token = sources.newest(spark, batches) or "", uuid.uuid4().hex
        _settle(spark, store)
        fresh = stored(sources.unseen_ids(rows, store, f"{store}-index", "Activity ID"), "ingest")
        try:
            first = sources.reserve(spark, f"{store}-serials", batches, token, fresh.count())
            version = sources.write_table(clean_activities(fresh, first - 1), batches, token=token, expect=at)
            break
        except sources.Conflict:
            continue
        finally:
            discard(fresh)
    discard(rows)
    _settle(spark, store)
    while True:
        at = sources.newest(spark, metadata) or ""
        old = sources.load_table(spark, metadata, at) if at else None
        upto = old.agg(F.max("upto")).first()[0] or "" if old is not None else ""
        pending = [spark.read.parquet(f"{batches}/{v}").select(F.col("`Athlete ID`").alias("athlete_id")) for v in sources.versions(spark, batches) if upto < v <= version]
        if not pending:  # another run has been here
            break
        metrics = op.training_metrics(sums.read_sums(spark, f"{store}-sums", _SUM_KEYS, _SUMS, of=op.stack(*pending)), end_week)
        added = metrics.withColumn("weeks", F.lit(end_week - start_week))
        if old is not None:
            added = op.stack(update_metadata(old.drop("upto"), metrics, start_week, end_week), op.unseen(added, old, ["athlete_id"]))
        try:
            sources.write_table(added.withColumn("upto", F.lit(version)), metadata, expect=at)
            break
        except sources.Conflict:
            continue
    sums.compact(spark, f"{store}-sums", lambda at: sums.read_sums(spark, f"{store}-sums", _SUM_KEYS, _SUMS, version=at), "athlete_id")
    return op.ingest_report(spark.read.parquet(f"{batches}/{version}"), "Athlete Name")
