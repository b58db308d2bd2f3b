"""Registered queries: metrics, calibration, uncertainty, slices, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators import bootstrap, calibration, labels, metrics, profile, slices
from fleetwatch.plans.registry import query
from fleetwatch.plans.sql import (
    AVERAGE_PRECISION,
    METRIC_BLOCKS,
    OPERATING,
    OPERATING_RATES,
    compose,
    hash32,
    thresholds,
)
from fleetwatch.plans.stages import PLAIN_SCORERS, Study
from fleetwatch.session import new_path
from fleetwatch.sources import reports, snapshot

BUDGETS = (0.0, 0.01, 0.1, 0.25)
RULE_SCORE = "risk_sector_count_rule"
TIED_SCORE = "risk_wear_index"
SMOOTH_SCORE = "risk_load_index"
CUT = 0.6
COLUMNS = {m: f"risk_{m}" for m in PLAIN_SCORERS}
SMOOTH = {"load_index": SMOOTH_SCORE}


def _loose_thresholds(s: Study) -> dict[str, float]:
    """Thresholds at a budget of 10%, so that every count is well above 0."""
    return metrics.thresholds_at_fpr(s.validation(), COLUMNS, 0.1)


# --- rare-event metrics ----------------------------------------------------------------------------


@query(compose("preds", " union all ".join(
    f"select scorer as model, cast({b} as double) as max_fpr, t as threshold from thr{i}"
    for i, b in enumerate(BUDGETS)), *[thresholds(b, f"thr{i}") for i, b in enumerate(BUDGETS)],
    doubles=["threshold", "max_fpr"]))
def threshold_at_fpr(s: Study) -> DataFrame:
    found = metrics.thresholds_at_budgets(s.validation(), COLUMNS, list(BUDGETS), rows_per_range=50)
    rows = [(m, b, t) for (m, b), t in found.items()]
    return s.spark.createDataFrame(rows, "model string, max_fpr double, threshold double")


@query(compose("preds", "select scorer as model, value as average_precision from ap where split = 'test'",
               AVERAGE_PRECISION, doubles=["average_precision"]))
def average_precision(s: Study) -> DataFrame:
    return metrics.average_precision(s.test(), COLUMNS, rows_per_range=50)


_CURVE = """points as (
  select s, cp, cp / (cp + cn) as precision, cast(cp as double) / (select sum(will_fail_30d) from test) as recall,
         coalesce(lag(cp) over (order by s desc) <> cp, true) as up,
         coalesce(lead(cp) over (order by s desc) <> cp, true) as down
  from steps where split = 'test' and scorer = 'load_index')"""


@query(compose("preds", "select 'load_index' as model, s as threshold, precision, recall from points "
               "union all select 'load_index', cast(null as double), 1.0, 0.0", AVERAGE_PRECISION, _CURVE,
               doubles=["threshold", "precision", "recall"]))
def pr_curve(s: Study) -> DataFrame:
    return metrics.pr_curve(s.test(), SMOOTH, rows_per_range=40)


@query(compose("preds", "select 'load_index' as model, s as threshold, precision, recall from points "
               "where up or down union all select 'load_index', cast(null as double), 1.0, 0.0", AVERAGE_PRECISION, _CURVE,
               doubles=["threshold", "precision", "recall"]))
def pr_curve_corners(s: Study) -> DataFrame:
    """The curve without points that lie between two with the same recall."""
    return metrics.pr_curve(s.test(), SMOOTH, drop_intermediate=True, rows_per_range=40)


@query(compose("preds", "select * exclude (split) from operating where split = 'test'",
               thresholds(0.1), OPERATING, doubles=OPERATING_RATES))
def operating_metrics(s: Study) -> DataFrame:
    return metrics.operating_metrics(s.test(), _loose_thresholds(s))


@query(compose("preds", "select serial_number, failure_date, detected, cast(lead_days as bigint) as lead_days "
               "from rolled where scorer = 'wear_index' and split = 'test'", thresholds(0.1), OPERATING,
               dates=["failure_date"]))
def event_rollup(s: Study) -> DataFrame:
    limit = metrics.threshold_at_fpr(s.validation(), TIED_SCORE, 0.1)
    rolled = metrics.event_rollup(s.test(), TIED_SCORE, limit)
    return rolled.withColumn("lead_days", F.col("lead_days").cast("bigint"))


_SLICE = """sliced as (
  select risk_wear_index >= 0.6 as a, will_fail_30d = 1 as p from test
  where obs_date between date '2024-01-24' and date '2024-01-26'),
counted as (
  select count(*) filter (where a and p) as tp, count(*) filter (where a and not p) as fp,
         count(*) filter (where not a and p) as fn, count(*) filter (where not a and not p) as tn from sliced)"""


@query(compose("preds", "select tp, fp, fn, tn, tp + fp as flagged, tp / greatest(1, tp + fp) as precision, "
               "tp / greatest(1, tp + fn) as recall, fp / greatest(1, fp + tn) as false_positive_rate from counted",
               _SLICE, doubles=["precision", "recall", "false_positive_rate"]))
def cutoff_metrics(s: Study) -> DataFrame:
    return metrics.cutoff_metrics(s.test(), TIED_SCORE, CUT, "2024-01-24", "2024-01-26")


_WIDE = ", ".join(
    f"max(case when split = '{p}' and metric = '{m}' then value end) as {p}_{m}"
    for p in ("validation", "test")
    for m in metrics.METRICS
)


@query(compose("preds", f"select model, {_WIDE} from metrics group by model", *METRIC_BLOCKS,
               doubles=[f"{p}_{m}" for p in ("validation", "test") for m in metrics.METRICS]))
def metrics_wide(s: Study) -> DataFrame:
    return metrics.metrics_wide(s.metrics())


@query(compose("preds", "select model, split, metric, value from metrics", *METRIC_BLOCKS, doubles=["value"]))
def evaluate_scores(s: Study) -> DataFrame:
    return s.metrics()


@query(compose("preds", "select model, split, metric, value from metrics", *METRIC_BLOCKS, doubles=["value"]))
def write_metrics(s: Study) -> DataFrame:
    """Metrics written as report files and read back."""
    path = new_path(s.spark, "report")
    reports.write_metrics(s.metrics(), path)
    return reports.read_metrics(s.spark, path)


@query(compose("preds", "select scorer as model, t as threshold from thr", thresholds(0.01), doubles=["threshold"]))
def thresholds_of(s: Study) -> DataFrame:
    """Thresholds read back from stored metrics."""
    return s.spark.createDataFrame(
        list(metrics.thresholds_of(s.metrics()).items()), "model string, threshold double"
    )


@query()
def learned_metrics(s: Study) -> DataFrame:
    """Every metric of the learned scorers, the forest and the rule on both holdouts."""
    return s.learned_metrics()


_HEADLINES = (
    "average_precision",
    "recall",
    "precision",
    "false_positive_rate",
    "alerts_per_1000_drive_days",
    "failure_events_with_any_alert_recall",
    "median_lead_days_detected_events",
)
_HEADLINE_SQL = ", ".join(f"max(case when metric = '{m}' then value end) as {m}" for m in _HEADLINES)


@query(compose("preds", f"select model, {_HEADLINE_SQL} from metrics where split = 'test' group by model",
               *METRIC_BLOCKS, doubles=_HEADLINES))
def compare_models(s: Study) -> DataFrame:
    return metrics.compare_models(s.metrics())


@query(compose("preds", f"select model, {_HEADLINE_SQL} from metrics where split = 'test' group by model "
               "order by average_precision desc limit 1", *METRIC_BLOCKS, doubles=_HEADLINES))
def best_model(s: Study) -> DataFrame:
    return metrics.best_model(s.metrics())


@query(compose("preds", """select o.model as model, ap.value / o.prevalence as lift,
         cast(round(o.failure_events_with_any_alert_recall * o.eligible_failure_events) as bigint)
           as covered_events, cast(o.eligible_failure_events as bigint) as eligible_events
  from operating o join ap on ap.scorer = o.model and ap.split = o.split where o.split = 'test'""",
               thresholds(0.01), AVERAGE_PRECISION, OPERATING, doubles=["lift"]))
def lift(s: Study) -> DataFrame:
    return metrics.lift(s.metrics())


# --- calibration -----------------------------------------------------------------------------------


def _bins(score: str, bins: int = 10) -> str:
    shares = ", ".join(repr(i * (1 / bins)) if i < bins else "1.0" for i in range(bins + 1))
    return f"""clipped as (
  select greatest(0.0, least(1.0, {score})) as p, will_fail_30d as y from test),
cuts as (select distinct unnest(quantile_cont(p, [{shares}])) as e from clipped),
inner_cuts as (select e from cuts where e > (select min(e) from cuts) and e < (select max(e) from cuts)),
binned as (
  select c.p, c.y, (select count(*) from inner_cuts i where i.e <= c.p) as bin from clipped c),
bins as (
  select cast(bin as integer) as bin, count(*) as rows, avg(p) as mean_predicted_probability,
         avg(cast(y as double)) as observed_prevalence, cast(sum(y) as bigint) as positives
  from binned group by bin)"""


_BIN_DOUBLES = ["mean_predicted_probability", "observed_prevalence"]


@query(compose("preds", "select * from bins", _bins(SMOOTH_SCORE), doubles=_BIN_DOUBLES))
def calibration_bins(s: Study) -> DataFrame:
    return calibration.calibration_bins(s.test(), SMOOTH_SCORE, rows_per_range=40)


@query(compose("preds", "select * from bins", _bins(TIED_SCORE), doubles=_BIN_DOUBLES))
def calibration_bins_with_ties(s: Study) -> DataFrame:
    return calibration.calibration_bins(s.test(), TIED_SCORE)


@query(compose("preds", "select sum(rows * abs(mean_predicted_probability - observed_prevalence)) / sum(rows) "
               "as expected_calibration_error from bins", _bins(SMOOTH_SCORE),
               doubles=["expected_calibration_error"]))
def ece(s: Study) -> DataFrame:
    return calibration.ece(calibration.calibration_bins(s.test(), SMOOTH_SCORE))


@query(compose("preds", "select avg((risk_load_index - will_fail_30d) * (risk_load_index - will_fail_30d)) "
               "as brier_score from test", doubles=["brier_score"]))
def brier(s: Study) -> DataFrame:
    return calibration.brier(s.test(), SMOOTH_SCORE)


def _bars(score: str, bins: int, by: str | None = None) -> str:
    """Bins by comparing each value with the edges of every bin."""
    key = f", {by}" if by else ""
    classes = "cross join (values (0), (1)) c(will_fail_30d)" if by else ""
    same = f" and v.{by} = g.{by}" if by else ""
    return f"""span as (select min({score}) as lo, max({score}) as hi from test),
grid as (
  select cast(i as integer) as bin{key}, lo + i * ((hi - lo) / {bins}) as low,
         case when i = {bins} - 1 then hi else lo + (i + 1) * ((hi - lo) / {bins}) end as high
  from span, range({bins}) r(i) {classes}),
bars as (
  select g.bin{", g." + by if by else ""}, g.low, g.high, count(v.{score}) as n
  from grid g left join test v on v.{score} >= g.low
    and (v.{score} < g.high or (g.bin = {bins} - 1 and v.{score} <= g.high)){same}
  group by all)"""


@query(compose("preds", "select * from bars", _bars(RULE_SCORE, 36), doubles=["low", "high"]))
def histogram(s: Study) -> DataFrame:
    return calibration.histogram(s.test(), RULE_SCORE, 36)


@query(compose("preds", "select * from bars", _bars(SMOOTH_SCORE, 55, "will_fail_30d"), doubles=["low", "high"]))
def histogram_by_class(s: Study) -> DataFrame:
    return calibration.histogram(s.test(), SMOOTH_SCORE, 55, by=labels.LABEL)


# --- uncertainty and slices ------------------------------------------------------------------------

_ENTITY_COUNTS = f"""judged as (
  select serial_number, failure_date, will_fail_30d as y, {TIED_SCORE} >= {CUT} as hit from test),
tallies as (
  select serial_number, count(*) filter (where hit and y = 1) as tp, count(*) filter (where hit and y = 0) as fp,
         count(*) filter (where not hit and y = 1) as fn, count(*) filter (where not hit and y = 0) as tn
  from judged group by serial_number),
their_events as (
  select serial_number, count(*) as events, count(*) filter (where found) as detected_events
  from (select serial_number, failure_date, bool_or(hit) as found from judged where y = 1
        group by serial_number, failure_date) group by serial_number),
entity_counts as (
  select t.serial_number, tp, fp, fn, tn, coalesce(events, 0) as events,
         coalesce(detected_events, 0) as detected_events
  from tallies t left join their_events e on t.serial_number = e.serial_number)"""


@query(compose("preds", "select * from entity_counts", _ENTITY_COUNTS))
def entity_counts(s: Study) -> DataFrame:
    return bootstrap.entity_counts(s.test(), TIED_SCORE, CUT)


@query(compose("preds", "select serial_number, tp + fn as positives, events, detected_events from entity_counts",
               _ENTITY_COUNTS))
def with_event_counts(s: Study) -> DataFrame:
    test = s.test()
    positives = test.groupBy("serial_number").agg(F.sum(labels.LABEL).alias("positives"))
    return bootstrap.with_event_counts(positives, metrics.event_rollup(test, TIED_SCORE, CUT))


_REPLICATES = 300
_HASH = hash32("serial_number")
_DRAWS = f"""numbered as (
  select *, row_number() over (order by {_HASH}, serial_number) - 1 as place, count(*) over () as size
  from entity_counts),
replicas as (
  select r.i as rep, {hash32("concat('42:', cast(r.i as varchar), ':', cast(j.i as varchar))")}
           % (select max(size) from numbered) as place
  from range({_REPLICATES}) r(i), range((select count(*) from entity_counts)) j(i)),
totals as (
  select rep, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn, sum(events) as ev,
         sum(detected_events) as de
  from replicas join numbered on replicas.place = numbered.place group by rep),
rates as (
  select tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall,
         fp / greatest(fp + tn, 1) as false_positive_rate,
         (tp + fp) / greatest(tp + fp + fn + tn, 1) * 1000 as alerts_per_1000_drive_days,
         de / greatest(ev, 1) as failure_event_recall from totals)"""


@query(compose("preds", " union all ".join(
    f"select '{r}' as metric, cast(quantile_cont({r}, 0.025) as double) as lower_95, "
    f"cast(quantile_cont({r}, 0.975) as double) as upper_95 from rates"
    for r in bootstrap.RATES), _ENTITY_COUNTS, _DRAWS, doubles=["lower_95", "upper_95"]))
def cluster_bootstrap(s: Study) -> DataFrame:
    return bootstrap.cluster_bootstrap(bootstrap.entity_counts(s.test(), TIED_SCORE, CUT), _REPLICATES)


_RATES = _DRAWS[_DRAWS.index("rates as ("):]
_INTERVALS = " union all ".join(
    f"select '{r}' as metric, cast(quantile_cont({r}, 0.025) as double) as lower_95, "
    f"cast(quantile_cont({r}, 0.975) as double) as upper_95 from rates" for r in bootstrap.RATES)
_CLASSES = f"""classes as materialized (
  select *, row_number() over (order by {hash32("label")}, label) - 1 as place
  from (select tp, fp, fn, tn, events, detected_events, count(*) as members,
               concat_ws(':', tp, fp, fn, tn, events, detected_events) as label from entity_counts group by all))"""
_TOTALS = """totals as (
  select rep, sum(tp * draws) as tp, sum(fp * draws) as fp, sum(fn * draws) as fn, sum(tn * draws) as tn,
         sum(events * draws) as ev, sum(detected_events * draws) as de from drawn group by rep)"""


def _order(k: str, mode: str) -> str:
    """Place of an outcome in the order mode, mode + 1, mode - 1, mode + 2, ..."""
    return f"case when {k} > {mode} then 2 * ({k} - {mode}) - 1 else 2 * ({mode} - {k}) end"


def _tree_draws(levels: int = 10) -> list[str]:
    """CTEs that draw class counts down the tree of at most ``2 ** levels`` classes."""
    u = f"({hash32("concat('42:', cast(rep as varchar), ':', cast(node as varchar))")} + 0.5) / 4294967296"
    parts = [
        "leaves as (select 1 << cast(ceil(log2(greatest(count(*), 1))) as int) as first from classes)",
        """tree as materialized (
  select (place + first) >> up as node, sum(case when ((place + first) >> (up - 1)) % 2 = 0 then members else 0 end) as l,
         sum(members) as m from classes, leaves, range(1, 20) r(up) where (place + first) >> up > 0 group by 1)""",
        """state_0 as (select i as rep, 1 as node, (select count(*) from entity_counts) as draws
  from range(""" + str(_REPLICATES) + ") t(i))",
    ]
    for i in range(levels):
        parts += [
            f"""open_{i} as materialized (
  select rep, node, draws, l / m as p, least(floor((draws + 1) * (l / m)), draws) as mode, {u} as u
  from state_{i} join tree using (node) where draws > 0)""",
            f"""sums_{i} as (
  select o.*, k, sum(exp(lgamma(draws + 1) - lgamma(k + 1) - lgamma(draws - k + 1) + k * ln(p) + (draws - k) * ln(1 - p)))
           over (partition by rep, node order by {_order("k", "mode")}) as c, {_order("k", "mode")} as place
  from open_{i} o, lateral (select unnest(range(draws + 1)) as k) where p > 0 and p < 1)""",
            f"""left_{i} as materialized (
  select rep, node, arg_min(k, place) as k from sums_{i} where c > u group by rep, node
  union all select rep, node, case when p >= 1 then draws else 0 end from open_{i} where p <= 0 or p >= 1)""",
            f"""state_{i + 1} as materialized (
  select rep, 2 * node as node, k as draws from open_{i} join left_{i} using (rep, node)
  union all select rep, 2 * node + 1, draws - k from open_{i} join left_{i} using (rep, node)
  union all select rep, node, draws from state_{i} where node >= (select first from leaves))""",
        ]
    return [
        *parts,
        f"""drawn as (select s.rep, s.draws, c.* from state_{levels} s join classes c
  on s.node = c.place + (select first from leaves) where s.draws > 0)""",
    ]


@query(compose("preds", _INTERVALS, _ENTITY_COUNTS, _CLASSES, *_tree_draws(), _TOTALS, _RATES, doubles=["lower_95", "upper_95"]))
def cluster_bootstrap_classes(s: Study) -> DataFrame:
    """Intervals from class counts drawn down a tree."""
    return bootstrap.cluster_bootstrap(bootstrap.entity_counts(s.test(), TIED_SCORE, CUT), _REPLICATES, method="classes")


_POISSON = f"""weighted as (
  select i as rep, c.*, ({hash32("concat('42:', cast(i as varchar), ':', label)")} + 0.5) / 4294967296 as u
  from classes c, range({_REPLICATES}) t(i)),
poisson_sums as (
  select rep, label, k, u, {_order("k", "members")} as nth,
         sum(exp(k * ln(members) - members - lgamma(k + 1))) over (partition by rep, label order by {_order("k", "members")}) as c
  from weighted, lateral (select unnest(range(members * 4 + 40)) as k)),
weights as (select rep, label, arg_min(k, nth) as draws from poisson_sums where c > u group by rep, label),
drawn as (select w.rep, w.draws, c.* from weights w join classes c using (label))"""


@query(compose("preds", _INTERVALS, _ENTITY_COUNTS, _CLASSES, _POISSON, _TOTALS, _RATES, doubles=["lower_95", "upper_95"]))
def cluster_bootstrap_poisson(s: Study) -> DataFrame:
    """Intervals from Poisson weights per class."""
    return bootstrap.cluster_bootstrap(bootstrap.entity_counts(s.test(), TIED_SCORE, CUT), _REPLICATES, method="poisson")


_SLICES = """judged as (
  select strftime(obs_date, '%Y-%m') as month, device, a.scorer, y, hit from alerts a where split = 'test'),
parts as (select 'month' as slice, month as value, scorer, y, hit from judged
          union all select 'model', device, scorer, y, hit from judged)"""


@query(compose("preds", """select slice, value, scorer as model, count(*) as rows, cast(sum(y) as bigint) as positives,
         avg(cast(y as double)) as prevalence,
         count(*) filter (where hit and y = 1) / nullif(count(*) filter (where y = 1), 0)
           as recall_at_validation_threshold,
         coalesce(count(*) filter (where hit and y = 1) / nullif(count(*) filter (where hit), 0), 0)
           as precision_at_validation_threshold,
         count(*) filter (where not hit and y = 1) as false_negatives,
         count(*) filter (where hit and y = 0) as false_positives
  from parts group by slice, value, scorer having count(*) >= 45""", thresholds(0.1), OPERATING, _SLICES,
               doubles=["prevalence", "recall_at_validation_threshold", "precision_at_validation_threshold"]))
def error_slices(s: Study) -> DataFrame:
    return slices.error_slices(s.test(), _loose_thresholds(s), min_rows=45)


# --- profile ---------------------------------------------------------------------------------------


@query(compose("fleet", "select count(*) as n_rows, count(distinct serial_number) as n_entities, "
               "min(cast(date as date)) as first_day, max(cast(date as date)) as last_day from fleet",
               dates=["first_day", "last_day"]))
def fleet_totals(s: Study) -> DataFrame:
    return profile.fleet_totals(s.raw())


@query(compose("features", "select count(*) as n_rows, cast(sum(will_fail_30d) as bigint) as positives, "
               "cast(sum(case when will_fail_30d = 0 then 1 else 0 end) as bigint) as negatives, "
               "round(avg(cast(will_fail_30d as double)) * 100, 4) as prevalence_pct from features",
               doubles=["prevalence_pct"]))
def label_totals(s: Study) -> DataFrame:
    return profile.label_totals(s.features())


@query(compose("fleet", "select cast(date as date) as date, count(*) as row_count from fleet group by 1",
               dates=["date"]))
def daily_population(s: Study) -> DataFrame:
    return profile.daily_population(s.raw())


@query(compose("features", "select cast(year(obs_date) as integer) as year, cast(month(obs_date) as integer) as month, "
               "count(*) as row_count, cast(sum(will_fail_30d) as bigint) as positives, "
               "avg(cast(will_fail_30d as double)) * 100 as prevalence_pct from features group by 1, 2",
               doubles=["prevalence_pct"]))
def monthly_prevalence(s: Study) -> DataFrame:
    return profile.monthly_prevalence(s.features())


@query(compose("features", "select model, count(*) as row_count, cast(sum(will_fail_30d) as bigint) as positives "
               "from features group by model order by row_count desc, model limit 3"))
def top_models(s: Study) -> DataFrame:
    return profile.top_models(s.features(), 3)


@query(compose("fleet", " union all ".join(
    f"select {n} as attribute, avg(case when try_cast(smart_{n}_raw as double) is null then 1.0 else 0.0 end) * 100 "
    "as missing_pct from fleet" for n in (5, 9, 187, 194, 197, 198)), doubles=["missing_pct"]))
def missingness(s: Study) -> DataFrame:
    return profile.missingness(s.raw())


_DAILY = "daily as (select cast(date as date) as date, count(*) as n from fleet group by 1)"


@query(compose("fleet", "select min(date) as first_low_day, max(date) as last_low_day from daily "
               "where n < (select avg(n) from daily)", _DAILY, dates=["first_low_day", "last_low_day"]))
def low_population(s: Study) -> DataFrame:
    """Days below the average population."""
    daily = profile.daily_population(s.stored_raw())
    usual = daily.agg(F.avg("row_count")).first()[0]
    return profile.low_population(daily, usual)


_PER_DAY = f"""per_day as (
  select obs_date, count(*) as drive_days, cast(sum(will_fail_30d) as bigint) as positive_days,
         count(*) filter (where {TIED_SCORE} >= {CUT}) as alerts,
         count(*) filter (where {TIED_SCORE} >= {CUT} and will_fail_30d = 1) as detected_days
  from test group by obs_date)"""


@query(compose("preds", "select * from per_day", _PER_DAY, dates=["obs_date"]))
def daily_alerts(s: Study) -> DataFrame:
    return profile.daily_alerts(s.test(), TIED_SCORE, CUT)


@query(compose("fleet", "select model, count(*) as drive_records, count(*) filter (where failure = '1') as failures "
               "from fleet where date = (select max(date) from fleet) group by model "
               "order by drive_records desc, model limit 4"))
def snapshot_models(s: Study) -> DataFrame:
    return profile.snapshot_models(s.snapshot(), 4)
