"""Building blocks of the SQL that the queries are checked against.

Written for a plain SQL engine, on other ways than the Spark side where there are any: joins instead of
per-key lookups, one ordered window instead of ranges, correlated comparisons instead of bins.
"""

from __future__ import annotations

from fleetwatch.plans.stages import HORIZON, LOAD_HALF, PLAIN_SCORERS, SPLIT, WEAR_HALF

ATTRS = (5, 9, 194, 197)
CHANGES = (5, 197)
RAW_COLUMNS = (
    "date, serial_number, model, capacity_bytes, failure, smart_5_raw, smart_9_raw, smart_187_raw, "
    "smart_194_raw, smart_197_raw, smart_198_raw, filename"
)


def hash32(text: str) -> str:
    return f"cast(concat('0x', substr(md5({text}), 1, 8)) as bigint)"


def bucket(text: str, n: int | str) -> str:
    return f"({hash32(text)} % {n})"


ROW_KEY = "concat(serial_number, ':', cast(obs_date as varchar))"

FLEET = """fleet as (
  select cast(cast(ts as date) as varchar) as date,
         concat('D', lpad(cast(user_id as varchar), 6, '0')) as serial_number,
         concat('M', cast(user_id % 5 as varchar)) as model,
         cast((1 + user_id % 4) * 1000000000000 as varchar) as capacity_bytes,
         case when max(value) >= 200 then '1' else '0' end as failure,
         cast(cast(sum(case when event_type = 'error' then cast(round(value * 100) as bigint) end) as bigint)
              as varchar) as smart_5_raw,
         cast(count(*) as varchar) as smart_9_raw,
         cast(null as varchar) as smart_187_raw,
         cast(max(case when event_type = 'click' then cast(round(value * 100) as bigint) end) as varchar)
           as smart_194_raw,
         cast(cast(sum(case when event_type = 'view' then cast(round(value * 100) as bigint) end) as bigint)
              as varchar) as smart_197_raw,
         cast(null as varchar) as smart_198_raw,
         'events.parquet' as filename
  from events group by cast(ts as date), user_id)"""

LABELED = f"""days as (
  select *, try_cast(date as date) as d, coalesce(try_cast(failure as integer), 0) as f from fleet),
ev as (
  select serial_number, min(case when f = 1 then d end) as failure_date, max(d) as last_seen,
         count(*) as n_rows
  from days group by serial_number),
gaps as (
  select days.*, ev.failure_date, ev.last_seen, datediff('day', d, ev.failure_date) as ahead,
         datediff('day', d, ev.last_seen) as followed
  from days join ev on days.serial_number = ev.serial_number),
labeled as (
  select {RAW_COLUMNS}, failure_date, last_seen,
         case when ahead >= 1 then case when ahead <= {HORIZON} then 1 else 0 end
              when failure_date is null and followed >= {HORIZON} then 0 end as will_fail_30d,
         case when ahead >= 1 and ahead <= {HORIZON} then 'positive'
              when ahead > {HORIZON} then 'negative_before_later_failure'
              when failure_date is null and followed >= {HORIZON} then 'negative'
              else 'insufficient_followup' end as label_status
  from gaps where f = 0)"""


def _stats() -> str:
    calls = {"mean": "avg", "max": "max", "std": "stddev_pop", "count": "count"}
    return ",\n         ".join(
        f"{fn}(v{n}) over w{d} as smart_{n}_{s}_{d}d" for n in ATTRS for d in (7, 30) for s, fn in calls.items()
    )


_TYPED = ", ".join(f"try_cast(smart_{n}_raw as double) as v{n}" for n in ATTRS)
_RAW_PAIRS = ", ".join(
    f"v{n} as smart_{n}_raw_num, case when v{n} is null then 1 else 0 end as smart_{n}_missing" for n in ATTRS
)
_CHANGE = ", ".join(
    f"case when datediff('day', lag(d) over seq, d) between 1 and 7 then v{n} - lag(v{n}) over seq end "
    f"as smart_{n}_change"
    for n in CHANGES
)
STAT_NAMES = [f"smart_{n}_{s}_{d}d" for n in ATTRS for d in (7, 30) for s in ("mean", "max", "std", "count")]
PAIR_NAMES = [c for n in ATTRS for c in (f"smart_{n}_raw_num", f"smart_{n}_missing")]
CHANGE_NAMES = [f"smart_{n}_change" for n in CHANGES]
FEATURE_NAMES = [
    "date",
    "obs_date",
    "serial_number",
    "filename",
    "model",
    "capacity_bytes",
    *PAIR_NAMES,
    *STAT_NAMES,
    *CHANGE_NAMES,
    "failure_date",
    "will_fail_30d",
    "label_status",
]
FEATURE_DOUBLES = [
    "capacity_bytes",
    *[f"smart_{n}_raw_num" for n in ATTRS],
    *[c for c in STAT_NAMES if "_count_" not in c],
    *CHANGE_NAMES,
]

FEATURES = f"""typed as (select *, {_TYPED} from days),
windowed as (
  select date, d as obs_date, serial_number, filename, model,
         try_cast(capacity_bytes as double) as capacity_bytes,
         {_RAW_PAIRS},
         {_stats()},
         {_CHANGE}
  from typed
  window w7 as (partition by serial_number order by d range between interval 6 days preceding and current row),
         w30 as (partition by serial_number order by d range between interval 29 days preceding and current row),
         seq as (partition by serial_number order by d)),
features as materialized (
  select w.*, l.failure_date, l.will_fail_30d, l.label_status
  from windowed w, labeled l
  where w.date = l.date and w.serial_number = l.serial_number and l.will_fail_30d is not null)"""

SPLIT_CASE = f"""case when obs_date < date '{SPLIT.train_cut}' then 'train'
              when obs_date >= date '{SPLIT.validation_start}' and obs_date < date '{SPLIT.validation_cut}'
                then 'validation'
              when obs_date >= date '{SPLIT.test_start}' and obs_date <= date '{SPLIT.test_cut}' then 'test'
              else 'purged_or_outside' end"""

PREDICTIONS = f"""preds as materialized (
  select obs_date, serial_number, model, failure_date, will_fail_30d, {SPLIT_CASE} as split,
         ln(1 + greatest(coalesce(smart_5_raw_num, 0), coalesce(smart_197_raw_num, 0)))
           as risk_sector_count_rule,
         coalesce(smart_194_mean_7d, 0) / (coalesce(smart_194_mean_7d, 0) + {LOAD_HALF}) as risk_load_index,
         coalesce(smart_9_max_7d, 0) / (coalesce(smart_9_max_7d, 0) + {WEAR_HALF}) as risk_wear_index
  from features),
test as (
  select obs_date, serial_number, model, failure_date, will_fail_30d, risk_sector_count_rule,
         risk_load_index, risk_wear_index from preds where split = 'test'),
validation as (
  select obs_date, serial_number, model, failure_date, will_fail_30d, risk_sector_count_rule,
         risk_load_index, risk_wear_index from preds where split = 'validation'),
scored as (
  """ + "\n  union all ".join(
    f"select split, '{m}' as scorer, obs_date, serial_number, model as device, failure_date, "
    f"will_fail_30d as y, risk_{m} as s from preds where split in ('validation', 'test')"
    for m in PLAIN_SCORERS
) + ")"


def thresholds(budget: float | str, name: str = "thr") -> str:
    """CTE with the threshold of every plain scorer."""
    return f"""{name} as (
  select scorer, coalesce(min(case when at_or_above <= floor({budget} * n + 1e-12) then s end),
                          nextafter(max(s), cast('infinity' as double))) as t
  from (select scorer, s, count(*) over (partition by scorer order by s desc) as at_or_above,
               count(*) over (partition by scorer) as n
        from scored where split = 'validation' and y = 0)
  group by scorer)"""


AVERAGE_PRECISION = """steps as (
  select scorer, split, s, p, n,
         sum(p) over (partition by scorer, split order by s desc) as cp,
         sum(n) over (partition by scorer, split order by s desc) as cn
  from (select scorer, split, s, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n
        from scored group by scorer, split, s)),
ap as materialized (
  select scorer, split, cast(coalesce(sum(p * (cp / (cp + cn))) / nullif(sum(p), 0), 0) as double) as value
  from steps group by scorer, split)"""

OPERATING = """alerts as (
  select x.*, x.s >= thr.t as hit, thr.t as t from scored x join thr on x.scorer = thr.scorer),
rolled as (
  select scorer, split, serial_number, failure_date, bool_or(hit) as detected,
         max(case when hit then datediff('day', obs_date, failure_date) end) as lead_days
  from alerts where y = 1 group by scorer, split, serial_number, failure_date),
events_of as (
  select scorer, split, count(*) as n_events, avg(case when detected then 1.0 else 0.0 end) as covered,
         median(case when detected then lead_days end) as lead
  from rolled group by scorer, split),
operating as materialized (
  select a.scorer as model, a.split as split, count(*) as rows, cast(sum(y) as bigint) as positive_rows,
         avg(cast(y as double)) as prevalence, max(t) as threshold_selected_on_validation_at_max_1pct_fpr,
         coalesce(count(*) filter (where hit and y = 1) / nullif(count(*) filter (where y = 1), 0), 0) as recall,
         coalesce(count(*) filter (where hit and y = 1) / nullif(count(*) filter (where hit), 0), 0)
           as precision,
         coalesce(count(*) filter (where hit and y = 0) / nullif(count(*) filter (where y = 0), 0), 0)
           as false_positive_rate,
         count(*) filter (where hit) / count(*) * 1000 as alerts_per_1000_drive_days,
         count(*) filter (where hit and y = 1) as true_positives,
         count(*) filter (where hit and y = 0) as false_positives,
         count(*) filter (where not hit and y = 1) as false_negatives,
         count(*) filter (where not hit and y = 0) as true_negatives,
         cast(max(coalesce(e.covered, 0)) as double) as failure_events_with_any_alert_recall,
         max(coalesce(e.n_events, 0)) as eligible_failure_events,
         cast(max(e.lead) as double) as median_lead_days_detected_events
  from alerts a left join events_of e on a.scorer = e.scorer and a.split = e.split
  group by a.scorer, a.split)"""

OPERATING_COUNTS = (
    "rows",
    "positive_rows",
    "true_positives",
    "false_positives",
    "false_negatives",
    "true_negatives",
    "eligible_failure_events",
)
OPERATING_RATES = (
    "prevalence",
    "threshold_selected_on_validation_at_max_1pct_fpr",
    "recall",
    "precision",
    "false_positive_rate",
    "alerts_per_1000_drive_days",
    "failure_events_with_any_alert_recall",
    "median_lead_days_detected_events",
)

TIDY = "metrics as materialized (\n  " + "\n  union all ".join(
    [
        *[
            f"select model, split, '{c}' as metric, cast({c} as double) as value from operating"
            for c in (*OPERATING_COUNTS, *OPERATING_RATES)
        ],
        "select scorer, split, 'average_precision', value from ap",
    ]
) + ")"

BLOCKS = {
    "fleet": [FLEET],
    "labeled": [FLEET, LABELED],
    "features": [FLEET, LABELED, FEATURES],
    "preds": [FLEET, LABELED, FEATURES, PREDICTIONS],
}
METRIC_BLOCKS = [thresholds(0.01), AVERAGE_PRECISION, OPERATING, TIDY]


def compose(level: str, tail: str, *extra: str, doubles=(), dates=()) -> str:
    """Tables up to a level, further CTEs, and the final select; doubles rounded and dates as text."""
    parts = [*BLOCKS.get(level, []), *extra]
    head = "with " + ",\n".join([*parts, f"answer as (\n  {tail})"])
    shown = [f"round({c}, 6) as {c}" for c in doubles] + [
        f"strftime({c}, '%Y-%m-%d') as {c}" for c in dates
    ]
    replaced = f" replace ({', '.join(shown)})" if shown else ""
    return f"{head}\nselect *{replaced} from answer"
