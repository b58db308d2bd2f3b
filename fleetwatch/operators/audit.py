"""Comparing one run with another. Every check gives rows ``(check, item, left, right, match)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.scores import is_close, off_by_more
from fleetwatch.operators.checksums import compare_trees, suspect_rows
from fleetwatch.operators.joins import match_predictions
from fleetwatch.operators.labels import ENTITY, LABEL, STATUS, label_counts
from fleetwatch.operators.sampling import sample_rows
from fleetwatch.sources import runs
from fleetwatch.sources.tables import schema_rows

CHECK_SCHEMA = "check string, item string, left_value string, right_value string, match boolean"
PROVENANCE = "filename"


def _check(df: DataFrame, name: str, item: Column, left: Column, right: Column, match: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        item.alias("item"),
        left.cast("string").alias("left_value"),
        right.cast("string").alias("right_value"),
        F.coalesce(match, F.lit(False)).alias("match"),
    )


def audit_counts(a: DataFrame, b: DataFrame, table: str) -> DataFrame:
    """Row counts of one table in both runs."""
    sides = a.agg(F.count(F.lit(1)).alias("n"), F.lit("left").alias("side")).unionByName(
        b.agg(F.count(F.lit(1)).alias("n"), F.lit("right").alias("side"))
    )
    one = sides.agg(
        F.max(F.when(F.col("side") == "left", F.col("n"))).alias("l"),
        F.max(F.when(F.col("side") == "right", F.col("n"))).alias("r"),
    )
    left, right = F.col("l"), F.col("r")
    return _check(one, f"{table}_rows", F.lit("rows"), left, right, left == right)


def audit_label_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows per label status in both runs."""
    left = label_counts(a).withColumnRenamed("n_rows", "l")
    right = label_counts(b).withColumnRenamed("n_rows", "r").withColumnRenamed(STATUS, "other")
    both = left.join(right, F.col(STATUS).eqNullSafe(F.col("other")), "full_outer")
    item = F.coalesce(STATUS, "other")
    return _check(both, "label_status_counts", item, F.col("l"), F.col("r"), F.col("l") == F.col("r"))


def audit_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """Name and type at each position of both schemas."""
    spelled = F.concat_ws(" ", "name", "type")
    left = schema_rows(a).select("position", spelled.alias("l"))
    right = schema_rows(b).select("position", spelled.alias("r"))
    both = left.join(right, "position", "full_outer")
    l, r = F.col("l"), F.col("r")
    return _check(both, "feature_schema", F.col("position").cast("string"), l, r, l == r)


def _compared(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("obs_date", ENTITY, PROVENANCE)]


def _value_checks(a: DataFrame, b: DataFrame, compared: list[str], name: str, what: str, least: int) -> DataFrame:
    """Check rows of two matched tables: sizes and overlap, keys whose copies differ, differences per column."""
    pairs = match_predictions(a, b, compared)
    weight = "if(a_copies is null or b_copies is null, 0, a_copies * b_copies)"
    # Spelled as SQL: a wide table has many of these, and text is cheaper to build than columns.
    one = pairs.selectExpr(
        "coalesce(sum(a_copies), 0) as l",
        "coalesce(sum(b_copies), 0) as r",
        f"coalesce(sum({weight}), 0) as m",
        "count_if(a_conflict) as lc",
        "count_if(b_conflict) as rc",
        *[
            f"coalesce(sum(if(`a_{c}` is distinct from `b_{c}`, {weight}, 0)), 0) as d_{i}"
            for i, c in enumerate(compared)
        ],
    )
    items = [f"'{what}', l, r, l >= {least} and l = r and l = m", "'conflicting keys', lc, rc, lc = 0 and rc = 0"]
    items += [f"'{c}', 0L, d_{i}, d_{i} = 0" for i, c in enumerate(compared)]
    rows = one.selectExpr(f"stack({len(items)}, {', '.join(items)}) as (item, left, right, ok)")
    return _check(rows, name, *[F.col(c) for c in ("item", "left", "right", "ok")])


def audit_values(a: DataFrame, b: DataFrame, modulus: int = 100) -> DataFrame:
    """Differences per column on a hash sample of entity-days, provenance excluded.

    Also the sizes of both samples and of their overlap, which must be equal and not 0. Equal copies
    are one row in the join and weigh as many pairs as they stand for; keys whose copies differ are counted, and fail.
    """
    samples = sample_rows(a, modulus), sample_rows(b, modulus)
    return _value_checks(*samples, _compared(a), "feature_values_sample", "sample rows", 1)


def audit_all_values(a: DataFrame, b: DataFrame, buckets: int | None = None) -> DataFrame:
    """Differences per column over all rows, provenance excluded, by checksums.

    Tables that agree are read once. Else only the rows of the buckets that differ are read again and matched: rows
    of those buckets, keys whose copies differ, and differences per column.
    """
    name, compared = "feature_values", _compared(a)
    if _compared(b) != compared:
        return _check(a.sparkSession.range(1), name, F.lit("columns"), F.lit(len(compared)), F.lit(len(_compared(b))), F.lit(False))
    found = compare_trees(a, b, [ENTITY, *compared], buckets)
    left, right = found.rows
    whole = a.sparkSession.range(1)
    rows = _check(whole, name, F.lit("rows"), F.lit(left), F.lit(right), F.lit(left == right and left > 0))
    if found.equal:
        items = ", ".join(f"'{c}'" for c in ("rows of differing buckets", "conflicting keys", *compared))
        same = whole.selectExpr(f"explode(array({items})) as item")
        return rows.unionByName(_check(same, name, F.col("item"), F.lit(0), F.lit(0), F.lit(True)))
    suspects = suspect_rows(a, found), suspect_rows(b, found)
    return rows.unionByName(_value_checks(*suspects, compared, name, "rows of differing buckets", 0))


def compare_predictions(
    a: DataFrame, b: DataFrame, scores: list[str], tolerance: float = 1e-8
) -> DataFrame:
    """One row: rows of both runs, keys missing and extra, keys whose copies differ, label and score mismatches, largest gaps."""
    pairs = match_predictions(a, b, [LABEL, *scores])
    both = F.col("a_copies").isNotNull() & F.col("b_copies").isNotNull()
    weight = F.col("a_copies") * F.col("b_copies")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    off = reduce(
        lambda x, y: x | y, [off_by_more(F.col(f"a_{s}"), F.col(f"b_{s}"), tolerance) for s in scores]
    )
    return pairs.agg(
        total(F.col("b_copies").isNull(), F.col("a_copies")).alias("missing_keys"),
        total(F.col("a_copies").isNull(), F.col("b_copies")).alias("extra_keys"),
        F.count_if(F.coalesce("a_conflict", F.lit(False)) | F.coalesce("b_conflict", F.lit(False))).alias("conflicting_keys"),
        total(both, weight).alias("matched_rows"),
        total(both & (F.col(f"a_{LABEL}") != F.col(f"b_{LABEL}")), weight).alias("label_mismatches"),
        total(both & off, weight).alias("score_mismatch_rows"),
        *[
            F.max(F.when(both, F.abs(F.col(f"a_{s}") - F.col(f"b_{s}")))).alias(f"{s}_max_abs_diff")
            for s in scores
        ],
    )


def audit_predictions(
    a: DataFrame, b: DataFrame, scores: list[str], tolerance: float = 1e-8
) -> DataFrame:
    """Parity of two prediction tables as check rows."""
    found = compare_predictions(a, b, scores, tolerance)
    items = ["missing_keys", "extra_keys", "conflicting_keys", "label_mismatches", "score_mismatch_rows"]
    pairs = ", ".join(f"'{i}', {i}" for i in items)
    long = found.selectExpr(f"stack({len(items)}, {pairs}) as (item, n)")
    name = "full_test_predictions"
    rows = audit_counts(a, b, name).withColumn("check", F.lit(name))
    return rows.unionByName(_check(long, name, F.col("item"), F.lit(0), F.col("n"), F.col("n") == 0))


def compare_metrics(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Tidy metrics of both runs side by side; NULL matches NULL."""
    on = ["model", "split", "metric"]
    left = a.select(*on, F.col("value").alias("left_value"))
    right = b.select(*on, F.col("value").alias("right_value"), F.lit(True).alias("found"))
    both = left.join(right, on, "left")
    close = is_close(F.col("left_value"), F.col("right_value"), tolerance, tolerance)
    match = F.coalesce(F.col("found"), F.lit(False)) & close
    return both.select(*on, "left_value", "right_value", match.alias("match"))


def audit_metrics(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Parity of every metric as check rows."""
    item = F.concat_ws("/", "model", "split", "metric")
    rows = compare_metrics(a, b, tolerance)
    return _check(rows, "holdout_metrics", item, F.col("left_value"), F.col("right_value"), F.col("match"))


def audit_verdict(*checks: DataFrame) -> DataFrame:
    """Per check the number of items and failures, and over all of them whether the audit passed."""
    rows = reduce(DataFrame.unionByName, checks)
    per_check = rows.groupBy("check").agg(
        F.count(F.lit(1)).alias("items"),
        F.count(F.when(~F.col("match"), 1)).alias("failures"),
    )
    overall = per_check.agg(
        F.lit("all").alias("check"), F.sum("items").alias("items"), F.sum("failures").alias("failures")
    )
    result = per_check.unionByName(overall)
    return result.withColumn("passed", F.coalesce(F.col("failures"), F.lit(1)) == 0)


def _count_check(table: str, left: int, right: int, a: DataFrame) -> DataFrame:
    """Rows of a table as both manifests state them."""
    return _check(a.sparkSession.range(1), f"{table}_rows", F.lit("rows"), F.lit(left), F.lit(right), F.lit(left == right))


def audit_runs(a: runs.Run, b: runs.Run, scores: list[str], tolerance: float = 1e-8) -> DataFrame:
    """All eight checks of two stored runs as check rows; ``audit_verdict`` sums them up.

    Row counts of telemetry, labels and features come from the manifests. All values of the features are compared, by
    checksums, not a sample.
    """
    tables = {n: (a.table(n), b.table(n)) for n in (runs.RAW, runs.LABELED, runs.FEATURES, runs.PREDICTIONS)}
    checks = [_count_check(n, a.rows(n), b.rows(n), tables[n][0]) for n in (runs.RAW, runs.LABELED, runs.FEATURES)]
    checks += [
        audit_label_counts(*tables[runs.LABELED]),
        audit_schema(*tables[runs.FEATURES]),
        audit_all_values(*tables[runs.FEATURES]),
        audit_metrics(a.metrics(), b.metrics(), tolerance),
        audit_predictions(*tables[runs.PREDICTIONS], scores, tolerance),
    ]
    return reduce(DataFrame.unionByName, checks)
