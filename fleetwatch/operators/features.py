"""As-of features over trailing calendar windows.

Every value of a row comes from that day or earlier days of the same entity. Windows run over source
rows, so failure days and rows without a known outcome still feed the history.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.functions.casts import failure_flag, lenient_date, lenient_double, missing_flag
from fleetwatch.functions.days import day_number
from fleetwatch.operators.keyed import (
    DEFAULT_LIMITS,
    SIZE,
    Limits,
    join_lookup,
    key_sizes,
    split_hot,
)
from fleetwatch.operators.labels import (
    DEFAULT_HORIZON,
    ENTITY,
    LABEL,
    STATUS,
    eligible,
    failure_events,
    label_columns,
    with_failure_event,
)
from fleetwatch.session import cut

# Attributes used as features, attributes with a change feature, window lengths,
# statistics, and the longest gap over which a change is taken.
ATTRIBUTES = (5, 9, 187, 194, 197, 198)
CHANGE_ATTRIBUTES = (5, 187, 197, 198)
WINDOW_DAYS = (7, 30)
STATISTICS = ("mean", "max", "std", "count")
MAX_GAP_DAYS = 7

DAY_NUMBER = "day_number"
_NO_DAY = -(2**31)


def _raw(n: int) -> str:
    return f"smart_{n}_raw"


def _value(n: int) -> str:
    return f"smart_{n}_raw_num"


def _stat(n: int, stat: str, days: int) -> str:
    return f"smart_{n}_{stat}_{days}d"


def _change(n: int) -> str:
    return f"smart_{n}_change"


def _values_in(attrs: Iterable[int]) -> list[Column]:
    return [F.count(lenient_double(_raw(n))).alias(f"values_{n}") for n in attrs]


def _present(raw: DataFrame, attrs: Iterable[int]) -> list[int]:
    return [n for n in attrs if _raw(n) in raw.columns]


def attribute_coverage(raw: DataFrame, attrs: Iterable[int] = ATTRIBUTES) -> DataFrame:
    """Usable values per attribute, one row each; attributes the source lacks have no row."""
    present = _present(raw, attrs)
    if not present:
        raise ValueError("none of the attributes is in the source")
    one_row = raw.agg(*_values_in(present))
    pairs = ", ".join(f"{n}, values_{n}" for n in present)
    return one_row.selectExpr(f"stack({len(present)}, {pairs}) as (attribute, n_values)")


def covered_attributes(raw: DataFrame, attrs: Iterable[int] = ATTRIBUTES) -> list[int]:
    """Attributes with at least one usable value."""
    counts = dict(attribute_coverage(raw, attrs).collect())
    return _require([n for n in attrs if counts.get(n)])


def _require(attrs: list[int]) -> list[int]:
    if not attrs:
        raise ValueError("no attribute has a usable value")
    return attrs


def typed_rows(raw: DataFrame, attrs: list[int]) -> DataFrame:
    """The source columns features need, typed, with the day as a number."""
    day = lenient_date("date")
    return raw.select(
        "date",
        day.alias("obs_date"),
        day_number(day).alias(DAY_NUMBER),
        ENTITY,
        "filename",
        "model",
        lenient_double("capacity_bytes").alias("capacity_bytes"),
        failure_flag("failure").alias("failure_flag"),
        *[lenient_double(_raw(n)).alias(_value(n)) for n in attrs],
    )


def change_features(rows: DataFrame, attrs: list[int], max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Difference to the previous row of the entity, if that row is 1 to ``max_gap`` days earlier.

    The previous row counts even when its value is NULL. Rows of one day are ordered by file and values.
    """
    changing = [n for n in CHANGE_ATTRIBUTES if n in attrs]
    if not changing:
        return rows
    ties = ["filename", *[_value(n) for n in attrs]]
    order = Window.partitionBy(ENTITY).orderBy(DAY_NUMBER, *ties)
    lagged = rows.select(
        "*",
        F.lag(DAY_NUMBER).over(order).alias("previous_day"),
        *[F.lag(_value(n)).over(order).alias(f"previous_{n}") for n in changing],
    )
    near = (F.col(DAY_NUMBER) - F.col("previous_day")).between(1, max_gap)
    return lagged.select(
        *rows.columns,
        *[F.when(near, F.col(_value(n)) - F.col(f"previous_{n}")).alias(_change(n)) for n in changing],
    )


def rolling_features(
    rows: DataFrame, attrs: list[int], days: tuple[int, ...] = WINDOW_DAYS
) -> DataFrame:
    """Mean, max, population deviation and count over the last ``d`` calendar days, today included."""
    over_days = {"sum": F.sum, "max": F.max, "std": F.stddev_pop, "count": F.count}
    by_day = Window.partitionBy(ENTITY).orderBy(DAY_NUMBER)
    framed = rows.select(
        "*",
        *[
            aggregate(_value(n)).over(by_day.rangeBetween(1 - d, 0)).alias(_stat(n, s, d))
            for n in attrs
            for d in days
            for s, aggregate in over_days.items()
        ],
    )

    def statistic(n: int, s: str, d: int) -> Column:
        # Sum over count is what an average does; sharing the count saves updates per frame.
        if s == "mean":
            return F.col(_stat(n, "sum", d)) / F.nullif(F.col(_stat(n, "count", d)), F.lit(0))
        return F.col(_stat(n, s, d))

    return framed.select(
        *rows.columns,
        *[statistic(n, s, d).alias(_stat(n, s, d)) for n in attrs for d in days for s in STATISTICS],
    )


def hot_history_features(
    rows: DataFrame,
    attrs: list[int],
    days: tuple[int, ...] = WINDOW_DAYS,
    max_gap: int = MAX_GAP_DAYS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The same change and rolling features for entities with too many rows for one task.

    A frame only depends on per-day summaries, so each (entity, day) is summarised first, with
    map-side combine. The windows then see one row per calendar day, however many rows there are, and
    the results are joined back to the rows.
    """
    changing = [n for n in CHANGE_ATTRIBUTES if n in attrs]
    # Row ids must not change when a lost task runs again, so the rows are written once.
    rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()), "hot_rows")
    values = [_value(n) for n in attrs]
    place = F.struct("filename", *values, "row_id")

    def summary(n: int) -> list[Column]:
        v = F.col(_value(n))
        return [
            F.count(v).alias(f"n_{n}"),
            F.avg(v).alias(f"mean_{n}"),
            F.max(v).alias(f"max_{n}"),
            (F.var_pop(v) * F.count(v)).alias(f"spread_{n}"),
        ]

    daily = rows.groupBy(ENTITY, DAY_NUMBER).agg(
        F.count(F.lit(1)).alias(SIZE),
        F.min(place)["row_id"].alias("first_row"),
        F.max(place).alias("last"),
        *[c for n in attrs for c in summary(n)],
    )
    order = Window.partitionBy(ENTITY).orderBy(DAY_NUMBER)
    moments = F.struct(DAY_NUMBER, *[f"{k}_{n}" for n in attrs for k in ("n", "mean", "spread")])
    framed = [F.collect_list(moments).over(order.rangeBetween(1 - max(days), 0)).alias("frame")]
    for n in attrs:
        for d in days:
            frame = order.rangeBetween(1 - d, 0)
            weighted = F.col(f"n_{n}") * F.col(f"mean_{n}")
            framed += [
                F.sum(f"n_{n}").over(frame).alias(_stat(n, "count", d)),
                F.sum(weighted).over(frame).alias(f"total_{n}_{d}"),
                F.max(f"max_{n}").over(frame).alias(_stat(n, "max", d)),
            ]
    near = (F.col(DAY_NUMBER) - F.lag(DAY_NUMBER).over(order)).between(1, max_gap)
    previous = F.when(near, F.lag("last").over(order)).alias("previous")
    windowed = daily.select(ENTITY, DAY_NUMBER, SIZE, "first_row", previous, *framed)
    windowed = windowed.select(
        "*",
        *[
            (F.col(f"total_{n}_{d}") / F.nullif(F.col(_stat(n, "count", d)), F.lit(0))).alias(
                _stat(n, "mean", d)
            )
            for n in attrs
            for d in days
        ],
    )

    def deviation(n: int, d: int) -> Column:
        mean = F.col(_stat(n, "mean", d))

        def add(total: Column, e: Column) -> Column:
            # The frame of a row without a day holds the rows without a day.
            inside = F.coalesce(e[DAY_NUMBER] > F.col(DAY_NUMBER) - d, F.lit(True)) & (e[f"n_{n}"] > 0)
            off = e[f"mean_{n}"] - mean
            return total + F.when(inside, e[f"spread_{n}"] + e[f"n_{n}"] * off * off).otherwise(0.0)

        total = F.aggregate("frame", F.lit(0.0), add)
        return F.sqrt(total / F.nullif(F.col(_stat(n, "count", d)), F.lit(0)))

    per_day = windowed.select(
        ENTITY,
        DAY_NUMBER,
        SIZE,
        "first_row",
        "previous",
        *[
            deviation(n, d).alias(_stat(n, s, d)) if s == "std" else F.col(_stat(n, s, d))
            for n in attrs
            for d in days
            for s in STATISTICS
        ],
    )
    per_day = cut(per_day, "hot_days")
    # Rows without a day meet the summary of the entity's rows without a day; a plain join would lose them.
    day = F.coalesce(DAY_NUMBER, F.lit(_NO_DAY)).alias("day_key")
    per_day = per_day.select("*", day).drop(DAY_NUMBER)
    joined = join_lookup(rows.select("*", day), per_day, [ENTITY, "day_key"], limits=limits).drop("day_key")
    is_first = F.col("row_id") == F.col("first_row")
    changes = [
        F.when(is_first, F.col(_value(n)) - F.col("previous")[_value(n)]).alias(_change(n))
        for n in changing
    ]
    return joined.select("*", *changes).drop("row_id", "first_row", "previous")


def _feature_columns(attrs: list[int], days: tuple[int, ...]) -> list[Column | str]:
    pairs = [c for n in attrs for c in (F.col(_value(n)), missing_flag(_value(n)).alias(f"smart_{n}_missing"))]
    stats = [_stat(n, s, d) for n in attrs for d in days for s in STATISTICS]
    changes = [_change(n) for n in CHANGE_ATTRIBUTES if n in attrs]
    return [
        "date",
        "obs_date",
        ENTITY,
        "filename",
        "model",
        "capacity_bytes",
        *pairs,
        *stats,
        *changes,
    ]


def window_features(
    rows: DataFrame,
    attrs: list[int],
    entities: DataFrame,
    limits: Limits = DEFAULT_LIMITS,
    days: tuple[int, ...] = WINDOW_DAYS,
) -> DataFrame:
    """Change and rolling features of typed rows; entities above the row limit take the summary way.

    ``entities`` has one row per entity with its number of rows.
    """
    sizes = key_sizes(entities)
    hot, others = split_hot(rows, entities, [ENTITY], sizes, limits)
    plain = rolling_features(change_features(others, attrs), attrs, days)
    if hot is None:
        return plain
    return plain.unionByName(hot_history_features(hot, attrs, days, limits=limits))


def join_labels(
    features: DataFrame,
    labeled: DataFrame,
    repeat_duplicates: bool = True,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Feature rows with the label of the same (date text, entity); rows without a label drop out.

    A feature row is repeated once per label copy, as by a plain inner join. The label of a key is the same in all
    its copies; without ``repeat_duplicates`` one copy is joined and each feature row stays one row.
    """
    keys, tail = ["date", ENTITY], ["failure_date", LABEL, STATUS]
    copies = F.count(F.lit(1))
    # A key's label is the same in every copy, so grouping by it as well gives one row per key.
    per_key = cut(
        labeled.groupBy(*keys, *tail).agg(copies.alias(SIZE), copies.alias("copies")), "labels_by_key"
    )
    joined = join_lookup(features, per_key, keys, limits=limits)
    if repeat_duplicates:
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy")
    return joined.select(*features.columns, *tail)


def build_features(
    raw: DataFrame,
    labeled: DataFrame | None = None,
    horizon_days: int = DEFAULT_HORIZON,
    attrs: Iterable[int] = ATTRIBUTES,
    limits: Limits = DEFAULT_LIMITS,
    repeat_duplicates: bool = True,
) -> DataFrame:
    """The feature table: one row per source row with a known outcome.

    One pass summarises each entity (coverage, failure day, size). Without a stored label table the
    labels are computed in the same rows, so the table costs one wide shuffle, for the windows.
    """
    present = _present(raw, attrs)
    entities = cut(failure_events(raw, _values_in(present)), "entities")
    found = entities.agg(*[F.sum(f"values_{n}").alias(str(n)) for n in present]).first() if present else {}
    kept = _require([n for n in present if found[str(n)]])
    known = entities.where(F.col(ENTITY).isNotNull()).select(ENTITY, "failure_date", "last_seen", SIZE)
    # A row without an entity never gets a label. A row without a day does not either; it sorts first,
    # is in no other row's frame, and gives the next row no change, so it needs no filter of its own.
    rows = typed_rows(raw.where(F.col(ENTITY).isNotNull()), kept)
    table = window_features(rows, kept, known, limits)
    columns = _feature_columns(kept, WINDOW_DAYS)
    if labeled is not None:
        labels = eligible(labeled).select("date", ENTITY, "failure_date", LABEL, STATUS)
        return join_labels(table.select(*columns), labels, repeat_duplicates, limits)
    label, status = label_columns(F.col("obs_date"), horizon_days)
    outcome = with_failure_event(table.where("failure_flag = 0"), known, limits=limits)
    outcome = outcome.withColumns({LABEL: label, STATUS: status})
    return eligible(outcome).select(*columns, "failure_date", LABEL, STATUS)
