"""Registered queries: joins, review reads, audits, models and attributions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import bucket as spark_bucket
from fleetwatch.functions.hashing import row_key
from fleetwatch.models import attribution, bundle, forest, prep, scorers
from fleetwatch.models.boosting import Boosting, node_rows
from fleetwatch.operators import audit, joins, labels, profile, review
from fleetwatch.operators.metrics import METRICS, thresholds_of
from fleetwatch.operators.splits import TEST, TRAIN
from fleetwatch.plans import sql_forest
from fleetwatch.plans.queries_evaluation import CUT, RULE_SCORE, SMOOTH_SCORE, TIED_SCORE, _PER_DAY
from fleetwatch.plans.queries_tables import _SNAPSHOT, _SNAP_DOUBLES
from fleetwatch.plans.registry import query
from fleetwatch.plans.sql import (
    FEATURE_DOUBLES,
    FEATURE_NAMES,
    METRIC_BLOCKS,
    ROW_KEY,
    bucket,
    compose,
    hash32,
)
from fleetwatch.plans.sql_boosting import DEVICES, NUMERIC, PLACES, boosted, prepared
from fleetwatch.plans.stages import ANOMALY, PLAIN_SCORERS, SPLIT, Study, score_sample
from fleetwatch.plans.stages import evaluate_saved as saved
from fleetwatch.session import new_path
from fleetwatch.sources import runs, snapshot
from fleetwatch.sources.tables import feature_columns

KEYS = ["obs_date", "serial_number"]
LABEL = labels.LABEL
SCORES = [f"risk_{m}" for m in PLAIN_SCORERS]
ALL_SCORES = ", ".join(SCORES)
TEST_COLUMNS = f"obs_date, serial_number, model, failure_date, {LABEL}, {ALL_SCORES}"
TEST_DATES = ["obs_date", "failure_date"]


# --- another run to compare with -------------------------------------------------------------------

_OTHER = f"""other as (
  select obs_date, serial_number, model, failure_date,
         case when {bucket(ROW_KEY, 11)} = 2 then 1 - {LABEL} else {LABEL} end as {LABEL},
         case when {bucket(ROW_KEY, 7)} = 3 then risk_sector_count_rule + 0.5 else risk_sector_count_rule end
           as risk_sector_count_rule,
         risk_load_index, risk_wear_index
  from test where {bucket(ROW_KEY, 13)} <> 1)"""
_SHORT = f"short as (select * from test where {bucket(ROW_KEY, 9)} <> 4)"


def _other_run(s: Study) -> DataFrame:
    """The test predictions of another run: some rows lost, some labels and scores changed."""
    rows = s.test().where(spark_bucket(row_key(), 13) != 1)
    moved = F.when(spark_bucket(row_key(), 7) == 3, F.col(RULE_SCORE) + 0.5).otherwise(F.col(RULE_SCORE))
    flipped = F.when(spark_bucket(row_key(), 11) == 2, 1 - F.col(LABEL)).otherwise(F.col(LABEL))
    return rows.withColumns({RULE_SCORE: moved, LABEL: flipped})


def _short_run(s: Study) -> DataFrame:
    """The test predictions of another run that lost other rows."""
    return s.test().where(spark_bucket(row_key(), 9) != 4)


# --- joins -----------------------------------------------------------------------------------------


@query(compose("labeled", "select d.date, d.serial_number, ev.failure_date, ev.last_seen from days d "
               "join ev on d.serial_number = ev.serial_number", dates=["failure_date", "last_seen"]))
def with_failure_event(s: Study) -> DataFrame:
    raw = s.stored_raw()
    joined = labels.with_failure_event(raw, labels.failure_events(raw))
    return joined.select("date", "serial_number", "failure_date", "last_seen")


@query(compose("labeled", "select serial_number, failure_date from ev where failure_date is not null",
               dates=["failure_date"]))
def first_failure_of(s: Study) -> DataFrame:
    return labels.first_failure_of(s.raw())


_CASES = f"""kinds as (
  select *, case when {LABEL} = 1 and {TIED_SCORE} >= {CUT} then 'detected_failure'
                 when {LABEL} = 1 then 'missed_failure'
                 when {TIED_SCORE} >= {CUT} then 'false_alarm' end as case_type from test),
cases as (
  select case_type, obs_date, serial_number, failure_date, {LABEL}, {TIED_SCORE}
  from (select *, row_number() over (partition by case_type
               order by case when case_type = 'missed_failure' then {TIED_SCORE} else -{TIED_SCORE} end,
                        serial_number, obs_date) as place from kinds where case_type is not null)
  where place = 1)"""


@query(compose("preds", "select * from cases", _CASES, doubles=[TIED_SCORE], dates=TEST_DATES))
def pick_cases(s: Study) -> DataFrame:
    return attribution.pick_cases(s.test(), TIED_SCORE, CUT)


@query(compose("preds", "select f.obs_date, f.serial_number, c.case_type, f.smart_9_raw_num, f.smart_9_max_7d "
               "from features f join cases c on f.obs_date = c.obs_date and f.serial_number = c.serial_number",
               _CASES, doubles=["smart_9_raw_num", "smart_9_max_7d"], dates=["obs_date"]))
def restore_cases(s: Study) -> DataFrame:
    cases = attribution.pick_cases(s.test(), TIED_SCORE, CUT).select("case_type", *KEYS)
    restored = joins.restore_cases(s.features(), cases)
    return restored.select(*KEYS, "case_type", "smart_9_raw_num", "smart_9_max_7d")


@query(compose("preds", f"select obs_date, serial_number, {TIED_SCORE}, {SMOOTH_SCORE} from test",
               doubles=[TIED_SCORE, SMOOTH_SCORE], dates=["obs_date"]))
def join_one_to_one(s: Study) -> DataFrame:
    a, b = s.test().select(*KEYS, TIED_SCORE), s.test().select(*KEYS, SMOOTH_SCORE)
    return joins.join_one_to_one(a, b)


@query(compose("preds", f"""select obs_date, serial_number, a.{LABEL} as a_{LABEL}, b.{LABEL} as b_{LABEL},
         a.{RULE_SCORE} as a_{RULE_SCORE}, b.{RULE_SCORE} as b_{RULE_SCORE},
         case when a.model is not null then 1 end as a_copies, case when b.model is not null then 1 end as b_copies,
         case when a.model is not null then false end as a_conflict, case when b.model is not null then false end as b_conflict
  from short a full outer join other b using (obs_date, serial_number)""", _OTHER, _SHORT,
               doubles=[f"a_{RULE_SCORE}", f"b_{RULE_SCORE}"], dates=["obs_date"]))
def match_predictions(s: Study) -> DataFrame:
    pairs = joins.match_predictions(_short_run(s), _other_run(s), [LABEL, RULE_SCORE])
    return pairs.withColumns({c: F.col(c).cast("int") for c in ("a_copies", "b_copies")})


@query(compose("preds", "select 'missing' as side, a.obs_date, a.serial_number, cast(1 as bigint) as copies from short a where not exists "
               "(select 1 from other b where a.obs_date = b.obs_date and a.serial_number = b.serial_number) "
               "union all select 'extra', b.obs_date, b.serial_number, 1 from other b where not exists "
               "(select 1 from short a where a.obs_date = b.obs_date and a.serial_number = b.serial_number)",
               _OTHER, _SHORT, dates=["obs_date"]))
def missing_keys(s: Study) -> DataFrame:
    a, b = _short_run(s), _other_run(s)
    missing = joins.missing_keys(a, b).select(F.lit("missing").alias("side"), *KEYS, "copies")
    return missing.unionByName(joins.missing_keys(b, a).select(F.lit("extra").alias("side"), *KEYS, "copies"))


# --- sorted reads and sets -------------------------------------------------------------------------


@query(compose("preds", f"select {TEST_COLUMNS} from test", doubles=SCORES, dates=TEST_DATES))
def ordered(s: Study) -> DataFrame:
    return review.ordered(s.test())


@query(compose("preds", f"select {TEST_COLUMNS} from test order by {TIED_SCORE} desc, serial_number, obs_date limit 25",
               doubles=SCORES, dates=TEST_DATES))
def top_alerts(s: Study) -> DataFrame:
    return review.top_alerts(s.test(), TIED_SCORE, 25)


@query(compose("fleet", "select date, serial_number, model, failure, smart_5_raw, "
               "row_number() over (order by failure desc, smart_5_raw desc nulls last, serial_number) as place "
               "from snap qualify place <= 40", _SNAPSHOT, doubles=["smart_5_raw"], dates=["date"]))
def review_sort(s: Study) -> DataFrame:
    """The first rows of the sorted snapshot, with the place each one got."""
    shown = review.review_sort(s.snapshot()).limit(40)
    listed = shown.agg(F.collect_list(F.struct("failure", "smart_5_raw", "serial_number")).alias("all"))
    numbered = listed.select(F.posexplode("all").alias("at", "row")).select(
        (F.col("at") + 1).cast("bigint").alias("place"), F.col("row.serial_number").alias("serial_number")
    )
    return shown.join(F.broadcast(numbered), "serial_number").select(
        "date", "serial_number", "model", "failure", "smart_5_raw", "place"
    )


_TITLED = ", ".join(
    f'{"capacity_bytes / 1000000000000" if c == "capacity_tb" else c} as "{t}"'
    for c, t in review.SNAPSHOT_TITLES.items()
)
_TITLED_DOUBLES = [f'"{t}"' for c, t in review.SNAPSHOT_TITLES.items() if c == "capacity_tb" or c.startswith("smart_")]


@query(compose("fleet", f"select {_TITLED} from snap order by failure desc, smart_5_raw desc nulls last, serial_number "
               "limit 50", _SNAPSHOT, doubles=_TITLED_DOUBLES, dates=['"Snapshot date"']))
def titled_snapshot(s: Study) -> DataFrame:
    return review.titled_snapshot(s.snapshot(), 50)


_REVIEW = f"""chosen as (
  select * from test where {LABEL} = 1
  union select * from (select * from test where {LABEL} = 0
                       order by {hash32(f"concat('42:', {ROW_KEY})")}, serial_number, obs_date limit 60)
  union select * from (select * from test order by {TIED_SCORE} desc, serial_number, obs_date limit 50))"""


@query(compose("preds", f"select {TEST_COLUMNS} from chosen", _REVIEW, doubles=SCORES, dates=TEST_DATES))
def risk_review_set(s: Study) -> DataFrame:
    return review.risk_review_set(s.test(), TIED_SCORE, negatives=60, alerts=50)


@query(compose("preds", "select 'validation' as split, obs_date, serial_number from validation union all "
               "select 'test', obs_date, serial_number from test", dates=["obs_date"]))
def stack_tables(s: Study) -> DataFrame:
    parts = {"validation": s.validation(), "test": s.test()}
    return review.stack_tables(*[df.select(F.lit(n).alias("split"), *KEYS) for n, df in parts.items()])


@query(compose("preds", "select distinct model from test where model is not null"))
def choices(s: Study) -> DataFrame:
    return review.choices(s.test(), "model")


_BUSIEST = """busiest as (
  select serial_number from test group by serial_number order by count(*) desc, serial_number limit 1)"""


def _busiest(s: Study) -> str:
    counts = s.test().groupBy("serial_number").count().orderBy(F.desc("count"), "serial_number")
    return counts.first()["serial_number"]


@query(compose("preds", f"select {TEST_COLUMNS} from test where serial_number = (select serial_number from busiest)",
               _BUSIEST, doubles=SCORES, dates=TEST_DATES))
def drive_history(s: Study) -> DataFrame:
    return review.drive_history(s.histories(), _busiest(s))


@query(compose("preds", f"select count(*) as days, min_by(model, obs_date) as model, max({LABEL}) as any_positive, "
               "min(failure_date) as failure_date from test "
               "where serial_number = (select serial_number from busiest)", _BUSIEST, dates=["failure_date"]))
def drive_summary(s: Study) -> DataFrame:
    return review.drive_summary(review.drive_history(s.histories(), _busiest(s)))


@query(compose("fleet", "select serial_number, model, failure from snap where model = 'M1' and not failure "
               "and contains(lower(serial_number), lower('d0000'))", _SNAPSHOT))
def review_filter(s: Study) -> DataFrame:
    rows = s.snapshot()
    found = review.review_filter(rows, model="M1", failed=False, serial="d0000")
    return found.select("serial_number", "model", "failure")


@query(compose("preds", f"select {TEST_COLUMNS} from test where obs_date between date '2024-01-24' and "
               "date '2024-01-25' and model = 'M2'", doubles=SCORES, dates=TEST_DATES))
def review_filter_days(s: Study) -> DataFrame:
    return review.review_filter(s.test(), "2024-01-24", "2024-01-25", model="M2")


@query(compose("preds", f"select {TEST_COLUMNS} from test where (contains(lower(serial_number), 'm3') or "
               f"contains(lower(model), 'm3')) and obs_date = date '2024-01-24' and {LABEL} = 0",
               doubles=SCORES, dates=TEST_DATES))
def search_reviews(s: Study) -> DataFrame:
    return review.search_reviews(s.test(), "m3", "2024-01-24", 0, TIED_SCORE)


@query(compose("preds", "select obs_date, positive_days / drive_days * 1000 as positives_per_1000, "
               "alerts / drive_days * 1000 as alerts_per_1000 from per_day", _PER_DAY,
               doubles=["positives_per_1000", "alerts_per_1000"], dates=["obs_date"]))
def daily_rates(s: Study) -> DataFrame:
    return review.daily_rates(profile.daily_alerts(s.test(), TIED_SCORE, CUT))


# --- audit -----------------------------------------------------------------------------------------

_FLIPPED = f"""changed as (
  select * replace (case when {bucket(ROW_KEY, 5)} = 2 then smart_9_max_7d + 1 else smart_9_max_7d end
                      as smart_9_max_7d, 'elsewhere' as filename)
  from features)"""
AUDIT_MOD = 4


def _changed_features(s: Study) -> DataFrame:
    raised = F.when(spark_bucket(row_key(), 5) == 2, F.col("smart_9_max_7d") + 1)
    changed = F.coalesce(raised, "smart_9_max_7d")
    return s.features().withColumns({"smart_9_max_7d": changed, "filename": F.lit("elsewhere")})


_COUNT_CHECK = """select '{t}' as "check", 'rows' as item, cast(l as varchar) as left_value,
         cast(r as varchar) as right_value, l = r as match
  from (select (select count(*) from short) as l, (select count(*) from other) as r)"""


@query(compose("preds", _COUNT_CHECK.format(t="predictions_rows"), _OTHER, _SHORT))
def audit_counts(s: Study) -> DataFrame:
    return audit.audit_counts(_short_run(s), _other_run(s), "predictions")


def _fewer_labels(s: Study) -> DataFrame:
    return s.labeled().where("date < '2024-01-29' and label_status <> 'positive'")


_AUDIT_LABELS = """fewer as (select * from labeled where date < '2024-01-29' and label_status <> 'positive'),
l as (select label_status, count(*) as n from labeled group by 1),
r as (select label_status, count(*) as n from fewer group by 1)"""


@query(compose("labeled", """select 'label_status_counts' as "check", coalesce(l.label_status, r.label_status) as item,
         cast(l.n as varchar) as left_value, cast(r.n as varchar) as right_value, coalesce(l.n = r.n, false) as match
  from l full outer join r on l.label_status = r.label_status""", _AUDIT_LABELS))
def audit_label_counts(s: Study) -> DataFrame:
    return audit.audit_label_counts(s.labeled(), _fewer_labels(s))


_SPARK_TYPES = {
    n: "double" if n in FEATURE_DOUBLES else "date" if n in ("obs_date", "failure_date")
    else "bigint" if "_count_" in n else "int" if n.endswith("_missing") or n == LABEL else "string"
    for n in FEATURE_NAMES
}
_MOVED = [c for c in FEATURE_NAMES if c != "filename"]


@query("select 'feature_schema' as \"check\", item, left_value, right_value, match from (values " + ", ".join(
    f"('{i}', '{a} {_SPARK_TYPES[a]}', "
    + (f"'{_MOVED[i]} {_SPARK_TYPES[_MOVED[i]]}'" if i < len(_MOVED) else "cast(null as varchar)")
    + f", {'true' if i < len(_MOVED) and _MOVED[i] == a else 'false'})"
    for i, a in enumerate(FEATURE_NAMES)) + ") as t(item, left_value, right_value, match)")
def audit_schema(s: Study) -> DataFrame:
    """The feature table against one that lacks a column: all later places differ."""
    return audit.audit_schema(s.features(), s.features().drop("filename"))


_COMPARED = [c for c in FEATURE_NAMES if c not in ("obs_date", "serial_number", "filename")]
_SAMPLES = f"""sa as (select * from features where {bucket(ROW_KEY, AUDIT_MOD)} = 0),
sb as (select * from changed where {bucket(ROW_KEY, AUDIT_MOD)} = 0),
sab as (select sa as a, sb as b from sa join sb
        on sa.obs_date = sb.obs_date and sa.serial_number = sb.serial_number)"""


@query(compose("features", """select 'feature_values_sample' as "check", 'sample rows' as item,
         cast(l as varchar) as left_value, cast(r as varchar) as right_value, l > 0 and l = r and l = m as match
  from (select (select count(*) from sa) as l, (select count(*) from sb) as r, (select count(*) from sab) as m)
  union all select 'feature_values_sample', 'conflicting keys', '0', '0', true
  union all """ + " union all ".join(
    f"select 'feature_values_sample', '{c}', '0', cast(count(*) filter (where a.{c} is distinct from b.{c}) as varchar), "
    f"count(*) filter (where a.{c} is distinct from b.{c}) = 0 from sab" for c in _COMPARED), _FLIPPED, _SAMPLES))
def audit_values(s: Study) -> DataFrame:
    return audit.audit_values(s.features(), _changed_features(s), AUDIT_MOD)


_ALL_PAIRS = """all_pairs as (select a, b from features a join changed b
        on a.obs_date = b.obs_date and a.serial_number = b.serial_number),
changed_days as (select distinct a.obs_date as day from all_pairs where a.smart_9_max_7d is distinct from b.smart_9_max_7d),
sizes as (select (select count(*) from features) as n,
                 (select count(*) from features where obs_date in (select day from changed_days)) as near)"""


@query(compose("features", """select 'feature_values' as "check", 'rows' as item, cast(n as varchar) as left_value,
         cast(n as varchar) as right_value, n > 0 as match from sizes
  union all select 'feature_values', 'rows of differing buckets', cast(near as varchar), cast(near as varchar), true from sizes
  union all select 'feature_values', 'conflicting keys', '0', '0', true
  union all """ + " union all ".join(
    f"select 'feature_values', '{c}', '0', cast(count(*) filter (where a.{c} is distinct from b.{c}) as varchar), "
    f"count(*) filter (where a.{c} is distinct from b.{c}) = 0 from all_pairs" for c in _COMPARED), _FLIPPED, _ALL_PAIRS))
def audit_all_values(s: Study) -> DataFrame:
    """All feature values against changed ones, by checksums of days and buckets."""
    return audit.audit_all_values(s.features(), _changed_features(s))


_BOTH = f"""both_runs as (
  select a.obs_date, a.{LABEL} as ya, b.{LABEL} as yb, {", ".join(f"abs(a.{c} - b.{c}) as d_{c}" for c in SCORES)}
  from short a join other b on a.obs_date = b.obs_date and a.serial_number = b.serial_number),
found as (
  select (select count(*) from short a where not exists (select 1 from other b where a.obs_date = b.obs_date
            and a.serial_number = b.serial_number)) as missing_keys,
         (select count(*) from other a where not exists (select 1 from short b where a.obs_date = b.obs_date
            and a.serial_number = b.serial_number)) as extra_keys,
         cast(0 as bigint) as conflicting_keys,
         count(*) as matched_rows, count(*) filter (where ya <> yb) as label_mismatches,
         count(*) filter (where {" or ".join(f"d_{c} > 1e-8" for c in SCORES)}) as score_mismatch_rows,
         {", ".join(f"max(d_{c}) as {c}_max_abs_diff" for c in SCORES)}
  from both_runs)"""


@query(compose("preds", "select * from found", _OTHER, _SHORT, _BOTH,
               doubles=[f"{c}_max_abs_diff" for c in SCORES]))
def compare_predictions(s: Study) -> DataFrame:
    return audit.compare_predictions(_short_run(s), _other_run(s), SCORES)


_PREDICTION_CHECKS = _COUNT_CHECK.format(t="full_test_predictions") + " union all " + " union all ".join(
    f"select 'full_test_predictions', '{i}', '0', cast({i} as varchar), {i} = 0 from found"
    for i in ("missing_keys", "extra_keys", "conflicting_keys", "label_mismatches", "score_mismatch_rows")
)


@query(compose("preds", _PREDICTION_CHECKS, _OTHER, _SHORT, _BOTH))
def audit_predictions(s: Study) -> DataFrame:
    return audit.audit_predictions(_short_run(s), _other_run(s), SCORES)


_METRIC_PAIRS = """moved as (
  select model, split, metric, case when metric = 'recall' then value + 0.001 else value end as value from metrics),
pairs as (
  select a.model, a.split, a.metric, a.value as left_value, b.value as right_value,
         (a.value is null and b.value is null) or coalesce(abs(a.value - b.value) <= 1e-8 + 1e-8 * abs(b.value), false)
           as match
  from metrics a join moved b on a.model = b.model and a.split = b.split and a.metric = b.metric)"""


def _moved_metrics(s: Study) -> DataFrame:
    moved = F.when(F.col("metric") == "recall", F.col("value") + 0.001).otherwise(F.col("value"))
    return s.metrics().withColumn("value", moved)


@query(compose("preds", "select * from pairs", *METRIC_BLOCKS, _METRIC_PAIRS, doubles=["left_value", "right_value"]))
def compare_metrics(s: Study) -> DataFrame:
    return audit.compare_metrics(s.metrics(), _moved_metrics(s))


@query(compose("preds", """select 'holdout_metrics' as "check", concat_ws('/', model, split, metric) as item, match
  from pairs""", *METRIC_BLOCKS, _METRIC_PAIRS))
def audit_metrics(s: Study) -> DataFrame:
    """Check rows of every metric; the values as text differ in spelling between engines."""
    return audit.audit_metrics(s.metrics(), _moved_metrics(s)).select("check", "item", "match")


@query(compose("preds", f"""select "check", count(*) as items, count(*) filter (where not match) as failures,
         count(*) filter (where not match) = 0 as passed from checks group by "check"
  union all select 'all', count(*), count(*) filter (where not match), count(*) filter (where not match) = 0
  from checks""", _OTHER, _SHORT, _BOTH, *METRIC_BLOCKS, _METRIC_PAIRS, f"""checks as (
  select "check", match from ({_PREDICTION_CHECKS})
  union all select 'holdout_metrics', match from pairs
  union all select 'label_status_counts', true from (select distinct label_status from labeled))"""))
def audit_verdict(s: Study) -> DataFrame:
    return audit.audit_verdict(
        audit.audit_predictions(_short_run(s), _other_run(s), SCORES),
        audit.audit_metrics(s.metrics(), _moved_metrics(s)),
        audit.audit_label_counts(s.labeled(), s.labeled()),
    )


def _run(s: Study, name: str) -> runs.Run:
    """A stored run: ``one``, ``again`` (the same written again), or ``changed``, whose labels, features, scores and metrics are others."""

    def build() -> runs.Run:
        root = s._once("runs_root", lambda: new_path(s.spark, "runs"))
        tables, metrics = {
            runs.RAW: s.stored_raw(),
            runs.LABELED: s.labeled(),
            runs.FEATURES: s.features(),
            runs.PREDICTIONS: _short_run(s),
        }, s.metrics()
        if name == "changed":
            tables |= {
                runs.LABELED: _fewer_labels(s),
                runs.FEATURES: _changed_features(s),
                runs.PREDICTIONS: _other_run(s),
            }
            metrics = _moved_metrics(s)
        return runs.save_run(s.spark, root, name, tables, metrics, s.thresholds())

    return s._once(f"run_{name}", build)


_VERDICT = """select "check", count(*) as items, count(*) filter (where not match) as failures,
         count(*) filter (where not match) = 0 as passed from checks group by "check"
  union all select 'all', count(*), count(*) filter (where not match), count(*) filter (where not match) = 0
  from checks"""


@query(compose("preds", _VERDICT, *METRIC_BLOCKS, f"""checks as (
  select unnest(['drive_days_rows', 'labeled_rows', 'features_rows']) as "check", true as match
  union all select 'label_status_counts', true from (select distinct label_status from labeled)
  union all select 'feature_schema', true from range({len(FEATURE_NAMES)})
  union all select 'feature_values', true from range({len(_COMPARED) + 3})
  union all select 'holdout_metrics', true from metrics
  union all select 'full_test_predictions', true from range(6))"""))
def audit_runs_same(s: Study) -> DataFrame:
    """The verdict of all eight checks over two stored runs of the same study."""
    return audit.audit_verdict(audit.audit_runs(_run(s, "one"), _run(s, "again"), SCORES))


@query(compose("preds", _VERDICT, _OTHER, _SHORT, _BOTH, *METRIC_BLOCKS, _METRIC_PAIRS, _FLIPPED, _ALL_PAIRS, _AUDIT_LABELS,
               f"""checks as (
  select unnest(['drive_days_rows', 'features_rows']) as "check", true as match
  union all select 'labeled_rows', (select count(*) from labeled) = (select count(*) from fewer)
  union all select 'label_status_counts', coalesce(l.n = r.n, false)
            from l full outer join r on l.label_status = r.label_status
  union all select 'feature_schema', true from range({len(FEATURE_NAMES)})
  union all select 'feature_values', true from range({len(_COMPARED) + 2})
  union all select 'feature_values', count(*) = 0 from changed_days
  union all select 'holdout_metrics', match from pairs
  union all select "check", match from ({_PREDICTION_CHECKS}))"""))
def audit_runs_changed(s: Study) -> DataFrame:
    """The verdict over two stored runs of which one has other labels, features, scores and metrics."""
    return audit.audit_verdict(audit.audit_runs(_run(s, "one"), _run(s, "changed"), SCORES))


# --- models and attributions -----------------------------------------------------------------------


@query(compose("features", f"select count(*) filter (where {LABEL} = 0) as negatives, "
               f"count(*) filter (where {LABEL} = 1) as positives, count(*) filter (where {LABEL} not in (0, 1)) "
               f"as other from features where obs_date < date '{SPLIT.train_cut}'"))
def class_counts(s: Study) -> DataFrame:
    return scorers.class_counts(s.splits()[TRAIN])


def _standardised(c: str) -> str:
    """A number as the preprocessing makes it: missing ones filled, mean 0 and sample deviation 1 over the training rows."""
    return f"case when s.d_{c} > 0 then (coalesce(f.{c}, m.{c}) - s.m_{c}) / s.d_{c} else 0.0 end as {c}"


_SPREAD = "spread as materialized (select " + ", ".join(
    f"avg(coalesce(t.{c}, m.{c})) as m_{c}, stddev_samp(coalesce(t.{c}, m.{c})) as d_{c}" for c in NUMERIC
) + " from train t, middle m)"


@query(compose("features", "select f.obs_date, f.serial_number, " + ", ".join(_standardised(c) for c in NUMERIC) + ", "
               + ", ".join(f"case when f.model = '{d}' then 1.0::double else 0.0 end as model_{d}" for d in DEVICES)
               + f" from features f, middle m, spread s where f.obs_date >= date '{SPLIT.test_start}' "
               f"and f.obs_date <= date '{SPLIT.test_cut}'", *prepared(Boosting())[:2], _SPREAD,
               dates=["obs_date"], doubles=[*NUMERIC, *[f"model_{d}" for d in DEVICES]]))
def prepare(s: Study) -> DataFrame:
    """The numbers of every test row's vector, by name."""
    places = s.prepared(TEST).select(*KEYS, vector_to_array(prep.FEATURES).alias("x"))
    return places.select(*KEYS, *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(_vector_names(s))])


@query(compose("preds", f"select obs_date, serial_number, model, {LABEL}, risk_sector_count_rule, true as in_range "
               "from test", doubles=["risk_sector_count_rule"], dates=["obs_date"]))
def score_holdout(s: Study) -> DataFrame:
    """All scorers on the whole test period; learned scores are only checked to be probabilities."""
    learned = [F.col(f"risk_{m}") for m in ("logistic_regression", "boosted_trees")]
    within = learned[0].between(0, 1) & learned[1].between(0, 1)
    within = within & F.col("anomaly_isolation_forest").between(-0.5, 0.5)
    scored = s.predictions().withColumn("in_range", within)
    return scored.select(*KEYS, "model", LABEL, RULE_SCORE, "in_range")


@query()
def fit_logistic(s: Study) -> DataFrame:
    """Coefficients by feature."""
    model = s.scorers()["logistic_regression"]
    names = _vector_names(s)
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients)]
    return s.spark.createDataFrame([*rows, ("intercept", float(model.intercept))], "feature string, value double")


@query("select feature, true as flat from (values " + ", ".join(f"('{n}')" for n in [*PLACES, "intercept"]) + ") t(feature)")
def logistic_gradient(s: Study) -> DataFrame:
    """At the fitted coefficients the slope of the penalised loss vanishes in every direction.

    Per direction the weighted residuals times the feature, plus the penalty's share, against the sum of their absolute values.
    """
    return scorers.logistic_gradient(s.training(), s.scorers()["logistic_regression"], _vector_names(s)).select(
        "feature", (F.abs("slope") <= 2e-3 * F.col("size")).alias("flat")
    )


_BOOSTED_ROUNDS = 3


@query(boosted(_BOOSTED_ROUNDS))
def fit_boosted(s: Study) -> DataFrame:
    """Nodes of the first boosted trees: the feature of each split with its gain, the value of each leaf."""
    names = dict(enumerate(_vector_names(s)))
    rows = [
        (tree, node, names.get(feature), gain, value, cover)
        for tree, node, feature, _, _, gain, value, cover in node_rows(s.scorers()["boosted_trees"], _BOOSTED_ROUNDS)
    ]
    schema = "tree int, node int, feature string, gain double, value double, cover double"
    return s.spark.createDataFrame(rows, schema)


@query(sql_forest.forest(sql_forest.NODES, doubles=["longest"]))
def fit_isolation_forest(s: Study) -> DataFrame:
    """Nodes and leaves per tree."""
    leaf = F.col("feature") < 0
    return s.forest().nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count(F.when(leaf, 1)).alias("leaves"), F.max("path").alias("longest")
    )


@query(sql_forest.forest(sql_forest.SCORES, walk=True, doubles=["anomaly_score"], dates=["obs_date", "failure_date"]))
def score_batches(s: Study) -> DataFrame:
    """Anomaly predictions of the whole test period."""
    return forest.score_batches(s.prepared(TEST), s.forest())


@query(sql_forest.forest(sql_forest.PATHS, walk=True, doubles=["mean_path", "shortest", "longest"]))
def isolation_paths(s: Study) -> DataFrame:
    """How long the paths of the test rows are in each tree, by joins with the node table."""
    paths = forest.walk(s.prepared(TEST), s.forest(), KEYS)
    return paths.groupBy("tree").agg(
        F.avg("path").alias("mean_path"), F.min("path").alias("shortest"), F.max("path").alias("longest")
    )


@query(compose("preds", "select obs_date, serial_number, true as same from test", dates=["obs_date"]))
def load_bundle(s: Study) -> DataFrame:
    """A saved and reloaded scorer gives the stored scores again."""
    path, test = new_path(s.spark, "bundle"), s.splits()[TEST]
    numeric, _ = feature_columns(test.columns)
    bundle.save_bundle(path, s.prep(), s.scorers()["logistic_regression"], numeric)
    again = bundle.load_bundle(path).score(test, "again").select(*KEYS, "risk_again")
    both = s.predictions().select(*KEYS, "risk_logistic_regression").join(again, KEYS)
    same = F.abs(F.col("risk_again") - F.col("risk_logistic_regression")) < 1e-12
    return both.select(*KEYS, same.alias("same"))


@query(compose("preds", "select obs_date, serial_number, true as same from test", dates=["obs_date"]))
def load_forest_bundle(s: Study) -> DataFrame:
    """A saved and reloaded forest gives the same anomaly scores again."""
    path, test = new_path(s.spark, "forest_bundle"), s.splits()[TEST]
    bundle.save_forest(path, s.prep(), s.forest(), feature_columns(test.columns)[0])
    again = bundle.load_forest(path).score(test, "again").select(*KEYS, "again")
    both = s.predictions().select(*KEYS, ANOMALY).join(again, KEYS)
    return both.select(*KEYS, (F.abs(F.col("again") - F.col(ANOMALY)) < 1e-12).alias("same"))


def _vector_names(s: Study) -> list[str]:
    return prep.vector_names(s.prep(), feature_columns(s.features().columns)[0])


def _adds_up(explained: DataFrame) -> DataFrame:
    total = F.aggregate(attribution.CONTRIBUTIONS, F.col(attribution.BASE), lambda a, v: a + v)
    gap = F.abs(total - F.col(attribution.MARGIN))
    return explained.select(*KEYS, (gap < 1e-8).alias("adds_up"))


_TEST_ROWS = compose("preds", "select obs_date, serial_number, true as adds_up from test", dates=["obs_date"])


@query(_TEST_ROWS)
def attribute_logistic(s: Study) -> DataFrame:
    """Contributions and base value add up to the margin on every test row."""
    rows = s.prepared(TEST)
    return _adds_up(attribution.attribute(rows, s.scorers()["logistic_regression"], rows))


@query(_TEST_ROWS)
def attribute_boosted(s: Study) -> DataFrame:
    """Contributions and base value add up to the margin on every test row."""
    return _adds_up(attribution.attribute(s.prepared(TEST), s.scorers()["boosted_trees"]))


@query()
def case_explanations(s: Study) -> DataFrame:
    """The picked cases with the five features that moved their boosted score most."""
    scored = s.predictions()
    limit = thresholds_of(s.learned_metrics())["boosted_trees"]
    cases = attribution.pick_cases(scored, "risk_boosted_trees", limit)
    rows = joins.restore_cases(s.features(), cases.select("case_type", *KEYS, "risk_boosted_trees"))
    explained = attribution.attribute(prep.prepare(rows, s.prep()), s.scorers()["boosted_trees"])
    top = attribution.top_contributors(explained, _vector_names(s))
    return top.select(
        "case_type",
        "serial_number",
        F.col("obs_date").alias("observation_date"),
        "failure_date",
        F.col(LABEL).alias("label"),
        "risk_boosted_trees",
        F.lit(limit).alias("threshold"),
        *[f"top_feature_{i}" for i in range(1, 6)],
    )


_LINEAR = {"smart_5_raw_num": 0.4, "smart_9_raw_num": -30.0, "smart_194_raw_num": 0.2, "smart_197_raw_num": 0.1}

_CENTERED = "explained as (select obs_date, serial_number, " + ", ".join(
    f"{w} * (coalesce({c}, 0) - avg(coalesce({c}, 0)) over ()) as {c}" for c, w in _LINEAR.items()
) + " from features)"


def _linear_contributions(s: Study) -> DataFrame:
    """Contributions of a linear score with fixed weights, the mean taken over all rows."""
    rows = s.features()
    means = rows.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in _LINEAR]).first()
    parts = [F.lit(w) * (F.coalesce(c, F.lit(0.0)) - F.lit(means[c])) for c, w in _LINEAR.items()]
    return rows.select(*KEYS, F.array(*parts).alias(attribution.CONTRIBUTIONS))


@query(compose("features", " union all ".join(
    f"select '{c}' as feature, avg(abs({c})) as mean_abs from explained" for c in _LINEAR), _CENTERED,
    doubles=["mean_abs"]))
def global_importance(s: Study) -> DataFrame:
    return attribution.global_importance(_linear_contributions(s), list(_LINEAR))


@query(compose("features", f"""select obs_date, serial_number,
         max(feature) filter (where place = 1) as top_feature_1, max(feature) filter (where place = 2) as top_feature_2
  from (select *, row_number() over (partition by obs_date, serial_number order by abs(v) desc, feature) as place
        from ({" union all ".join(f"select obs_date, serial_number, '{c}' as feature, {c} as v from explained" for c in _LINEAR)}))
  group by obs_date, serial_number""", _CENTERED, dates=["obs_date"]))
def top_contributors(s: Study) -> DataFrame:
    top = attribution.top_contributors(_linear_contributions(s), list(_LINEAR), 2)
    return top.select(*KEYS, "top_feature_1", "top_feature_2")


@query(compose("features", f"select obs_date, serial_number from features where {bucket(ROW_KEY, 50)} = 0",
               dates=["obs_date"]))
def explanation_sample(s: Study) -> DataFrame:
    return attribution.explanation_sample(s.features(), 50).select(*KEYS)


@query()
def boosted_importance(s: Study) -> DataFrame:
    """Mean absolute contribution per feature of the boosted trees over the test rows."""
    explained = attribution.attribute(s.prepared(TEST), s.scorers()["boosted_trees"])
    return attribution.global_importance(explained, _vector_names(s))


def _saved(s: Study) -> runs.Run:
    return s._once("saved_run", lambda: s.save_run(new_path(s.spark, "runs"), "study"))


_ALL_MODELS = ("logistic_regression", "boosted_trees", "isolation_forest", "sector_count_rule")


@query("select model, split, metric, true as same from (values " + ", ".join(f"('{m}')" for m in _ALL_MODELS)
       + ") a(model), (values ('validation'), ('test')) b(split), (values " + ", ".join(f"('{m}')" for m in METRICS) + ") c(metric)")
def evaluate_saved(s: Study) -> DataFrame:
    """Metrics of the saved models of a run, scored and evaluated anew, against those of the study that saved them."""
    _, again = saved(_saved(s), s.features(), s.split)
    keys = ["model", "split", "metric"]
    both = again.join(s.learned_metrics().withColumnRenamed("value", "before"), keys)
    close = F.abs(F.col("value") - F.col("before")) < 1e-9
    return both.select(*keys, F.coalesce(close, F.col("value").isNull() & F.col("before").isNull()).alias("same"))


@query(compose("preds", f"select obs_date, serial_number, {LABEL}, risk_sector_count_rule, true as same from test "
               f"where {LABEL} = 1 or {bucket('serial_number', 5)} = 0", doubles=["risk_sector_count_rule"], dates=["obs_date"]))
def scored_drilldown(s: Study) -> DataFrame:
    """The drill-down sample scored by the saved models; learned scores against those of the study."""
    sample = score_sample(_saved(s), s.features(), s.split, 5)
    learned = [ANOMALY, "risk_logistic_regression", "risk_boosted_trees"]
    before = s.predictions().select(*KEYS, *[F.col(c).alias(f"{c}_before") for c in learned])
    same = F.lit(True)
    for c in learned:
        same = same & (F.abs(F.col(c) - F.col(f"{c}_before")) < 1e-9)
    return sample.join(before, KEYS).select(*KEYS, LABEL, RULE_SCORE, same.alias("same"))
