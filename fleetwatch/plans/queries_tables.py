"""Registered queries: sources, casts, filters, labels, features, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions import casts, days, hashing, scores
from fleetwatch.operators import features as feat
from fleetwatch.operators import labels, ranking, review, sampling, splits
from fleetwatch.operators.keyed import Limits
from fleetwatch.plans.registry import query
from fleetwatch.plans.sql import (
    ATTRS,
    CHANGE_NAMES,
    FEATURE_DOUBLES,
    FEATURE_NAMES,
    RAW_COLUMNS,
    ROW_KEY,
    SPLIT_CASE,
    STAT_NAMES,
    bucket,
    compose,
    hash32,
)
from fleetwatch.plans.stages import HORIZON, SPLIT, Study
from fleetwatch.session import new_path
from fleetwatch.sources import daily_csv, snapshot, tables

PRED_KEYS = ["obs_date", "serial_number"]
FEATURE_LIST = ", ".join(FEATURE_NAMES)
LABELS = "will_fail_30d"


# --- sources and sinks -----------------------------------------------------------------------------


@query(compose("fleet", f"select {RAW_COLUMNS.replace(', filename', '')} from fleet"))
def read_daily_csv(s: Study) -> DataFrame:
    """Daily files in two layouts: the earlier half lacks a column and has the others in another order."""
    root, raw = new_path(s.spark, "daily_csv"), s.stored_raw().drop("filename")
    early = raw.where("date < '2024-01-16'").drop("smart_187_raw")
    late = raw.where("date >= '2024-01-16'")
    early.select(*reversed(early.columns)).write.option("header", "true").csv(f"{root}/early")
    late.write.option("header", "true").csv(f"{root}/late")
    read = daily_csv.read_daily_csv(s.spark, root)
    return read.select(*raw.columns)


@query(compose("features", f"select obs_date, serial_number, smart_9_raw_num, {LABELS} from features "
               f"where obs_date < date '{SPLIT.train_cut}' and {LABELS} = 1",
               doubles=["smart_9_raw_num"], dates=["obs_date"]))
def read_rows(s: Study) -> DataFrame:
    wanted = ["obs_date", "serial_number", "smart_9_raw_num", LABELS, "obs_date"]
    where = (F.col("obs_date") < F.lit(SPLIT.train_cut)) & (F.col(LABELS) == 1)
    return tables.read_rows(s.features(), wanted, where)


@query(compose("labeled", f"select {RAW_COLUMNS}, failure_date, last_seen, {LABELS}, label_status from labeled",
               dates=["failure_date", "last_seen"]))
def write_table(s: Study) -> DataFrame:
    path = new_path(s.spark, "written")
    tables.write_table(s.labeled(), path, day="date")
    return tables.open_table(s.spark, path)


@query("select * from (values "
       + ", ".join(
           f"({i}, '{n}', '"
           + ("double" if n in FEATURE_DOUBLES else "date" if n in ("obs_date", "failure_date")
              else "bigint" if "_count_" in n
              else "int" if n.endswith("_missing") or n == LABELS else "string")
           + "')"
           for i, n in enumerate(FEATURE_NAMES))
       + ") as t(position, name, type)")
def schema_rows(s: Study) -> DataFrame:
    return tables.schema_rows(s.features())


@query(compose("features", "select count(*) as n_rows from features"))
def row_count(s: Study) -> DataFrame:
    return tables.row_count(s.features())


_SNAPSHOT = """snap as (
  select try_cast(date as date) as date, serial_number, model,
         try_cast(capacity_bytes as double) as capacity_bytes, try_cast(failure as integer) = 1 as failure,
         try_cast(smart_5_raw as double) as smart_5_raw, try_cast(smart_9_raw as double) as smart_9_raw,
         try_cast(smart_187_raw as double) as smart_187_raw, cast(null as double) as smart_188_raw,
         try_cast(smart_194_raw as double) as smart_194_raw, try_cast(smart_197_raw as double) as smart_197_raw,
         try_cast(smart_198_raw as double) as smart_198_raw
  from fleet where try_cast(date as date) = (select max(try_cast(date as date)) from fleet))"""
_SNAP_DOUBLES = ["capacity_bytes", *[f"smart_{n}_raw" for n in (5, 9, 187, 188, 194, 197, 198)]]


@query(compose("fleet", "select * from snap", _SNAPSHOT, doubles=_SNAP_DOUBLES, dates=["date"]))
def latest_snapshot(s: Study) -> DataFrame:
    return s.snapshot()


@query(compose("fleet", "select * from snap", _SNAPSHOT, doubles=_SNAP_DOUBLES, dates=["date"]))
def latest_snapshot_of_text(s: Study) -> DataFrame:
    """The newest day of a table that is not stored by day."""
    return snapshot.latest_snapshot(s.raw())


# --- casts and scalar functions --------------------------------------------------------------------

_SPOILED = f"""spoiled as (
  select serial_number, date,
         case k when 0 then date when 1 then replace(date, '-', '/') when 2 then concat(' ', date, ' ')
                when 3 then concat(date, ' 00:00:00') when 4 then concat(date, 'x')
                when 5 then substr(date, 1, 7) when 6 then concat(date, 'T12') end as day_text,
         case k when 0 then smart_9_raw when 1 then concat(smart_9_raw, '.5') when 2 then concat(' ', smart_9_raw)
                when 3 then concat(smart_9_raw, 'e1') when 4 then concat('0x', smart_9_raw)
                when 5 then concat(smart_9_raw, 'd') when 6 then '' end as number_text,
         case k when 0 then failure when 1 then '1.0' when 2 then '1' when 3 then '0.4' when 4 then '2'
                when 5 then 'yes' when 6 then '' end as flag_text
  from (select *, {bucket("concat(serial_number, date)", 8)} as k from fleet))"""


def _spoiled(s: Study) -> DataFrame:
    """The fleet with every eighth of its texts spelled in another way."""
    k = hashing.bucket(F.concat("serial_number", "date"), 8)

    def spelled(*variants):
        out = F.when(k == 0, variants[0])
        for i, v in enumerate(variants[1:], 1):
            out = out.when(k == i, v)
        return out

    d, n = F.col("date"), F.col("smart_9_raw")
    return s.stored_raw().select(
        "serial_number",
        "date",
        spelled(
            d,
            F.translate(d, "-", "/"),
            F.concat(F.lit(" "), d, F.lit(" ")),
            F.concat(d, F.lit(" 00:00:00")),
            F.concat(d, F.lit("x")),
            F.substring(d, 1, 7),
            F.concat(d, F.lit("T12")),
        ).alias("day_text"),
        spelled(
            n,
            F.concat(n, F.lit(".5")),
            F.concat(F.lit(" "), n),
            F.concat(n, F.lit("e1")),
            F.concat(F.lit("0x"), n),
            F.concat(n, F.lit("d")),
            F.lit(""),
        ).alias("number_text"),
        spelled(
            F.col("failure"), F.lit("1.0"), F.lit("1"), F.lit("0.4"), F.lit("2"), F.lit("yes"), F.lit("")
        ).alias("flag_text"),
    )


@query(compose("fleet", "select serial_number, date, try_cast(day_text as date) as parsed from spoiled",
               _SPOILED, dates=["parsed"]))
def lenient_date(s: Study) -> DataFrame:
    return _spoiled(s).select("serial_number", "date", casts.lenient_date("day_text").alias("parsed"))


@query(compose("fleet", "select serial_number, date, try_cast(number_text as double) as parsed from spoiled",
               _SPOILED, doubles=["parsed"]))
def lenient_double(s: Study) -> DataFrame:
    return _spoiled(s).select("serial_number", "date", casts.lenient_double("number_text").alias("parsed"))


@query(compose("fleet", "select serial_number, date, coalesce(try_cast(flag_text as integer), 0) as flag "
               "from spoiled", _SPOILED))
def failure_flag(s: Study) -> DataFrame:
    return _spoiled(s).select("serial_number", "date", casts.failure_flag("flag_text").alias("flag"))


@query(compose("fleet", "select serial_number, date, case when smart_5_raw is null then 1 else 0 end as missing "
               "from fleet"))
def missing_flag(s: Study) -> DataFrame:
    return s.raw().select("serial_number", "date", casts.missing_flag("smart_5_raw").alias("missing"))


@query(compose("features", "select obs_date, serial_number, ln(1 + greatest(coalesce(smart_5_raw_num, 0), "
               "coalesce(smart_197_raw_num, 0))) as score from features", doubles=["score"], dates=["obs_date"]))
def rule_score(s: Study) -> DataFrame:
    score = scores.rule_score(F.col("smart_5_raw_num"), F.col("smart_197_raw_num"))
    return s.features().select(*PRED_KEYS, score.alias("score"))


@query(compose("features", "select obs_date, serial_number, datediff('day', obs_date, failure_date) as gap "
               "from features", dates=["obs_date"]))
def date_diff_days(s: Study) -> DataFrame:
    gap = days.date_diff_days(F.col("obs_date"), F.col("failure_date")).cast("bigint")
    return s.features().select(*PRED_KEYS, gap.alias("gap"))


@query("select event_id, strftime(cast(ts as date), '%Y-%m-%d') as day from events")
def to_day(s: Study) -> DataFrame:
    return s.events().select("event_id", casts.to_day("ts").alias("day"))


@query("select strftime(ts, '%Y-%m') as month, count(*) as n from events group by 1")
def month_key(s: Study) -> DataFrame:
    return s.events().groupBy(days.month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


_INPUTS = [c for c in FEATURE_NAMES if c == "capacity_bytes" or c.startswith("smart_")] + ["model"]


@query(compose("features", f"select {', '.join(_INPUTS)} from features",
               doubles=[c for c in _INPUTS if c in FEATURE_DOUBLES]))
def feature_columns(s: Study) -> DataFrame:
    numeric, categorical = tables.feature_columns(s.features().columns)
    return s.features().select(*numeric, *categorical)


@query(compose("labeled", f"select {RAW_COLUMNS}, failure_date, {LABELS}, label_status from labeled",
               dates=["failure_date"]))
def drop_internal(s: Study) -> DataFrame:
    return tables.drop_internal(s.labeled(), "last_seen")


@query(compose("preds", "select obs_date, serial_number, case when risk_sector_count_rule > 1 then 1.0 "
               "else risk_sector_count_rule end as clipped from test", doubles=["clipped"], dates=["obs_date"]))
def clip01(s: Study) -> DataFrame:
    return s.test().select(*PRED_KEYS, scores.clip01(F.col("risk_sector_count_rule")).alias("clipped"))


@query(compose("features", "select obs_date, serial_number, capacity_bytes / 1000000000000 as capacity_tb, "
               f"case when {LABELS} = 1 then 'Failure recorded in next 30 days' else 'No positive label' end "
               "as outcome from features", doubles=["capacity_tb"], dates=["obs_date"]))
def with_review_columns(s: Study) -> DataFrame:
    return review.with_review_columns(s.features()).select(*PRED_KEYS, "capacity_tb", "outcome")


@query(compose("features", "select cast(obs_date as varchar) as obs_date, serial_number, "
               "cast(failure_date as varchar) as failure_date from features"))
def iso_dates(s: Study) -> DataFrame:
    return days.iso_dates(s.features().select("obs_date", "serial_number", "failure_date"))


# --- filters ---------------------------------------------------------------------------------------


@query(compose("features", f"select split, obs_date, serial_number, {LABELS} from (select *, {SPLIT_CASE} as split "
               "from features) where split <> 'purged_or_outside'", dates=["obs_date"]))
def split_frames(s: Study) -> DataFrame:
    parts = [df.select(F.lit(n).alias("split"), *PRED_KEYS, LABELS) for n, df in s.splits().items()]
    return review.stack_tables(*parts)


@query(compose("fleet", "select date, serial_number, failure from fleet where failure = '0'"))
def drop_failure_days(s: Study) -> DataFrame:
    return labels.drop_failure_days(s.raw()).select("date", "serial_number", "failure")


@query(compose("labeled", f"select date, serial_number, {LABELS}, label_status from labeled "
               f"where {LABELS} is not null"))
def eligible(s: Study) -> DataFrame:
    return labels.eligible(s.labeled()).select("date", "serial_number", LABELS, "label_status")


@query(compose("features", f"select obs_date, serial_number, label_status from features where {LABELS} = 0",
               dates=["obs_date"]))
def of_class(s: Study) -> DataFrame:
    return labels.of_class(s.features(), 0).select(*PRED_KEYS, "label_status")


_PAIR = "smart_5_raw_num, smart_197_raw_num"


@query(compose("features", "select obs_date, serial_number from features "
               "where smart_5_raw_num is distinct from smart_197_raw_num", dates=["obs_date"]))
def differs(s: Study) -> DataFrame:
    return s.features().where(scores.differs(F.col("smart_5_raw_num"), F.col("smart_197_raw_num"))).select(*PRED_KEYS)


@query(compose("features", "select obs_date, serial_number from features "
               "where abs(coalesce(smart_5_raw_num, 0) - coalesce(smart_197_raw_num, 0)) > 500",
               dates=["obs_date"]))
def off_by_more(s: Study) -> DataFrame:
    far = scores.off_by_more(F.col("smart_5_raw_num"), F.col("smart_197_raw_num"), 500.0)
    return s.features().where(far).select(*PRED_KEYS)


@query(compose("features", "select obs_date, serial_number, (smart_194_mean_7d is null and smart_194_mean_30d is null) "
               "or coalesce(abs(smart_194_mean_7d - smart_194_mean_30d) <= 1.0 + 0.1 * abs(smart_194_mean_30d), false) "
               "as close from features", dates=["obs_date"]))
def is_close(s: Study) -> DataFrame:
    close = scores.is_close(F.col("smart_194_mean_7d"), F.col("smart_194_mean_30d"), 1.0, 0.1)
    return s.features().select(*PRED_KEYS, close.alias("close"))


# --- labels ----------------------------------------------------------------------------------------

_ALL_LABELED = f"select {RAW_COLUMNS}, failure_date, last_seen, {LABELS}, label_status from labeled"


@query(compose("labeled", "select serial_number, failure_date, last_seen, n_rows from ev",
               dates=["failure_date", "last_seen"]))
def failure_events(s: Study) -> DataFrame:
    return labels.failure_events(s.raw())


@query(compose("labeled", _ALL_LABELED, dates=["failure_date", "last_seen"]))
def horizon_labels(s: Study) -> DataFrame:
    return labels.horizon_labels(s.raw(), HORIZON)


@query(compose("labeled", _ALL_LABELED, dates=["failure_date", "last_seen"]))
def horizon_labels_hot_entities(s: Study) -> DataFrame:
    """The same labels with limits so low that every larger entity counts as hot."""
    return labels.horizon_labels(s.raw(), HORIZON, Limits(broadcast_keys=1, hot_rows=20))


_STRICT = f"""one_failure as (
  select {RAW_COLUMNS}, d, case when f = 1 and d = failure_date then 1 else 0 end as f1, failure_date
  from gaps),
ended as (select *, (select max(d) from one_failure) as e, datediff('day', d, failure_date) as ahead1
          from one_failure),
judged as (
  select *, case when ahead1 between 1 and {HORIZON} then 1
                 when ahead1 > {HORIZON} then 0
                 when failure_date is null and datediff('day', d, e) >= {HORIZON} then 0 end as y
  from ended)"""


@query(compose("labeled", f"""select d as date, serial_number, f1 as failure, failure_date,
         case when y is null then 0 else 1 end as label_eligible, y as {LABELS},
         case when y is not null then 'eligible' when f1 = 1 then 'failure_day'
              when datediff('day', d, e) <= {HORIZON} then 'insufficient_followup'
              else 'eligible' end as censor_reason from judged""", _STRICT, dates=["date", "failure_date"]))
def strict_labels(s: Study) -> DataFrame:
    """The strict contract allows one failure row per entity, so later ones are read as healthy days."""
    raw = s.stored_raw()
    known = labels.with_failure_event(raw, labels.failure_events(raw))
    first = (F.col("failure") == "1") & (casts.lenient_date("date") == F.col("failure_date"))
    once = known.withColumn("failure", F.when(first, "1").otherwise("0")).select(*raw.columns)
    made = labels.strict_labels(once, HORIZON)
    return made.select(
        "date", "serial_number", "failure", "failure_date", "label_eligible", LABELS, "censor_reason"
    )


@query(compose("labeled", """select cast(count(*) filter (where d is null) as bigint) as bad_days,
         cast(count(*) filter (where serial_number is null) as bigint) as no_entity,
         cast(count(*) filter (where f not in (0, 1)) as bigint) as bad_flags,
         (select cast(max(k) as bigint) from (select sum(f) as k from days group by serial_number))
           as most_failures from days"""))
def contract_counts(s: Study) -> DataFrame:
    return labels.contract_counts(s.raw())


@query(compose("labeled", "select label_status, count(*) as n_rows from labeled group by label_status"))
def label_counts(s: Study) -> DataFrame:
    return labels.label_counts(labels.horizon_labels(s.raw(), HORIZON))


# --- features --------------------------------------------------------------------------------------


def _window_sql(names: list[str]) -> str:
    doubles = [c for c in names if "_count_" not in c]
    return compose("features", f"select obs_date, serial_number, {', '.join(names)} from windowed",
                   doubles=doubles, dates=["obs_date"])


@query(_window_sql(STAT_NAMES))
def rolling_features(s: Study) -> DataFrame:
    rows = feat.typed_rows(s.raw(), list(ATTRS))
    return feat.rolling_features(rows, list(ATTRS)).select(*PRED_KEYS, *STAT_NAMES)


@query(_window_sql(CHANGE_NAMES))
def change_features(s: Study) -> DataFrame:
    rows = feat.typed_rows(s.raw(), list(ATTRS))
    return feat.change_features(rows, list(ATTRS)).select(*PRED_KEYS, *CHANGE_NAMES)


@query(_window_sql([*STAT_NAMES, *CHANGE_NAMES]))
def hot_history_features(s: Study) -> DataFrame:
    """All entities by the way meant for entities too large for one task."""
    rows = feat.typed_rows(s.raw(), list(ATTRS))
    made = feat.hot_history_features(rows, list(ATTRS), limits=Limits(broadcast_keys=1, hot_rows=20))
    return made.select(*PRED_KEYS, *STAT_NAMES, *CHANGE_NAMES)


@query(compose("features", f"select {FEATURE_LIST} from features",
               doubles=FEATURE_DOUBLES, dates=["obs_date", "failure_date"]))
def build_features(s: Study) -> DataFrame:
    return feat.build_features(s.raw(), horizon_days=HORIZON)


@query(compose("features", f"select {FEATURE_LIST} from features",
               doubles=FEATURE_DOUBLES, dates=["obs_date", "failure_date"]))
def join_labels(s: Study) -> DataFrame:
    """Features of the raw table joined to a stored label table."""
    return feat.build_features(s.stored_raw(), s.labeled())


@query(compose("fleet", " union all ".join(
    f"select {n} as attribute, count(try_cast(smart_{n}_raw as double)) as n_values from fleet"
    for n in (5, 9, 187, 194, 197, 198))))
def attribute_coverage(s: Study) -> DataFrame:
    return feat.attribute_coverage(s.raw())


# --- splits and samples ----------------------------------------------------------------------------


@query(compose("features", f"select obs_date, serial_number, k = 'train' as train, k = 'validation' as validation, "
               f"k = 'test' as test from (select *, {SPLIT_CASE} as k from features)", dates=["obs_date"]))
def temporal_masks(s: Study) -> DataFrame:
    masked = splits.temporal_masks(s.features(), SPLIT)
    return masked.select(*PRED_KEYS, "train", "validation", "test")


@query(compose("features", f"select split, count(*) as n_rows, cast(sum({LABELS}) as bigint) as positives, "
               f"avg(cast({LABELS} as double)) * 100 as prevalence_pct "
               f"from (select *, {SPLIT_CASE} as split from features) group by split", doubles=["prevalence_pct"]))
def split_summary(s: Study) -> DataFrame:
    return splits.split_summary(s.features(), SPLIT)


@query(compose("features", f"select obs_date, serial_number, {LABELS}, cast(case when {LABELS} = 1 then 1 else 3 end "
               f"as double) as sample_weight from features where {LABELS} = 1 or {bucket('serial_number', 3)} = 0",
               doubles=["sample_weight"], dates=["obs_date"]))
def sample_training(s: Study) -> DataFrame:
    return sampling.sample_training(s.features(), 0.3).select(*PRED_KEYS, LABELS, "sample_weight")


@query(compose("features", f"select obs_date, serial_number, {LABELS} from features where {LABELS} = 0 "
               f"and {bucket('serial_number', 4)} = 0", dates=["obs_date"]))
def sample_healthy(s: Study) -> DataFrame:
    return sampling.sample_healthy(s.features(), 0.25).select(*PRED_KEYS, LABELS)


@query(compose("features", f"select obs_date, serial_number, {LABELS} from features where {bucket(ROW_KEY, 10)} = 0",
               dates=["obs_date"]))
def sample_rows(s: Study) -> DataFrame:
    return sampling.sample_rows(s.features(), 10).select(*PRED_KEYS, LABELS)


@query(compose("features", f"select obs_date, serial_number, {LABELS} from (select *, {SPLIT_CASE} as k from features) "
               f"where k = 'test' and ({LABELS} = 1 or {bucket('serial_number', 5)} = 0)", dates=["obs_date"]))
def drilldown_sample(s: Study) -> DataFrame:
    return sampling.drilldown_sample(s.features(), SPLIT, 5).select(*PRED_KEYS, LABELS)


def _seeded(seed: int = 42) -> str:
    return hash32(f"concat('{seed}:', {ROW_KEY})")


@query(compose("features", f"select obs_date, serial_number from features where {LABELS} = 0 "
               f"order by {_seeded()}, serial_number, obs_date limit 300", dates=["obs_date"]))
def sample_n(s: Study) -> DataFrame:
    return sampling.sample_n(labels.of_class(s.features(), 0), 300).select(*PRED_KEYS)


# --- running totals --------------------------------------------------------------------------------


@query(compose("features", "select v as value, cast(n as bigint) as n, "
               "cast(sum(n) over (order by v desc) as bigint) as cum_n "
               "from (select smart_197_raw_num as v, count(*) as n from features "
               "where smart_197_raw_num is not null group by 1)", doubles=["value"]))
def prefix_sum(s: Study) -> DataFrame:
    """Running counts over distinct values, cut into ranges of about 50 values."""
    counts = s.features().groupBy(F.col("smart_197_raw_num").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranking.prefix_sum(counts, "value", ["n"], descending=True, rows_per_range=50)
    return ranked.rows.select("value", "n", "cum_n")


@query(compose("features", "select quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.5) as p50, "
               "quantile_cont(v, 0.99) as p99 from (select smart_197_raw_num as v from features)",
               doubles=["p10", "p50", "p99"]))
def exact_quantiles(s: Study) -> DataFrame:
    values = s.features().where("smart_197_raw_num is not null")
    found = ranking.exact_quantiles(values, "smart_197_raw_num", [0.1, 0.5, 0.99], rows_per_range=50)
    return s.spark.createDataFrame([tuple(found)], "p10 double, p50 double, p99 double")
