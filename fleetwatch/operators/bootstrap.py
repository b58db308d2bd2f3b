"""Uncertainty by resampling whole entities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import HASH_SPACE, bucket, hash32
from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.session import cut

COUNTS = ("tp", "fp", "fn", "tn", "events", "detected_events")
BROADCAST_ENTITIES = 250_000  # of seven numbers each: some 14 MB
ENTITIES_PER_RANGE = 500_000
LEVELS_PER_PLAN = 8  # of the tree of classes; then the counts are stored
# Rates of one resample; an empty denominator counts as 1.
RATES = (
    "precision",
    "recall",
    "false_positive_rate",
    "alerts_per_1000_drive_days",
    "failure_event_recall",
)


def with_event_counts(counts: DataFrame, events: DataFrame) -> DataFrame:
    """Per-entity row counts with the entity's number of events and detected events, 0 if it has none."""
    per_entity = events.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("detected"), 1)).alias("detected_events")
    )
    return counts.join(per_entity, ENTITY, "left").na.fill(0, ["events", "detected_events"])


def entity_counts(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Per entity: rows by outcome, failure events and detected events, in two aggregation levels.

    An event without a failure day is one event of its entity.
    """
    alert = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    positive = F.coalesce(F.col(LABEL) == 1, F.lit(False))
    per_event = df.groupBy(
        ENTITY, positive.alias("is_event"), F.when(positive, F.col("failure_date")).alias("event_day")
    ).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(alert, 1)).alias("alerts"))
    event, fired, silent = F.col("is_event"), F.col("alerts"), F.col("n") - F.col("alerts")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    return (
        per_event.where(F.col(ENTITY).isNotNull())
        .groupBy(ENTITY)
        .agg(
            total(event, fired).alias("tp"),
            total(~event, fired).alias("fp"),
            total(event, silent).alias("fn"),
            total(~event, silent).alias("tn"),
            F.count(F.when(event, 1)).alias("events"),
            F.count(F.when(event & (fired > 0), 1)).alias("detected_events"),
        )
    )


def number_entities(counts: DataFrame, n_ranges: int) -> DataFrame:
    """Adds ``position`` 0..n-1 in (hash, id) order.

    The hash is uniform, so equal hash ranges hold equal shares of the entities; each is numbered in
    its own task and shifted by the sizes of the ranges before it.
    """
    width = -(-HASH_SPACE // n_ranges)
    hashed = counts.withColumn("hash", hash32(F.col(ENTITY)))
    placed = hashed.withColumn("hash_range", F.floor(F.col("hash") / width))
    sizes = placed.groupBy("hash_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("hash_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("hash_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("hash_range").orderBy("hash", ENTITY)) - 1
    numbered = placed.withColumn("inside", inside).join(F.broadcast(starts), "hash_range")
    position = (F.col("start") + F.col("inside")).alias("position")
    return numbered.select(*counts.columns, position)


def _hash_draw_totals(counts: DataFrame, n: int, replicates: int, seed: int, most_broadcast: int) -> DataFrame:
    """Totals per replicate from n draws each; draw j of replicate r is a hash of (seed, r, j).

    Up to ``most_broadcast`` entities are broadcast; beyond that the draws of a replicate are counted per position,
    with map-side combine, and the counts meet the entities by a shuffle.
    """
    numbered = number_entities(counts, -(-n // ENTITIES_PER_RANGE))
    replicate, draw = F.expr(f"id div {n}"), F.col("id") % n
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    draws = counts.sparkSession.range(replicates * n).select(
        replicate.alias("replicate"), bucket(text, n).alias("position")
    )
    entities = numbered.select("position", *COUNTS)
    if n <= most_broadcast:
        drawn = draws.join(F.broadcast(entities), "position")
        return drawn.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in COUNTS])
    times = draws.groupBy("replicate", "position").agg(F.count(F.lit(1)).alias("times"))
    drawn = times.join(entities.hint("merge"), "position")
    return drawn.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in COUNTS])


def class_table(counts: DataFrame) -> DataFrame:
    """Entities with equal counts as one class: (counts, members, label); the label is the text of its counts."""
    label = F.concat_ws(":", *[F.col(c).cast("string") for c in COUNTS]).alias("label")
    return counts.groupBy(*COUNTS).agg(F.count(F.lit(1)).alias("members")).select("*", label)


def class_tree(classes: DataFrame) -> DataFrame:
    """(node, left_members, members): a binary tree over the classes, whose leaves are hash ranges of their labels.

    Nodes are numbered as in a heap. Leaves lie at one depth; each class is a leaf, numbered by its position in (hash,
    label) order, so the tree is the same on every engine.
    """
    n = classes.count()
    depth = tree_depth(n)
    placed = number_entities(classes.withColumnRenamed("label", ENTITY), -(-n // ENTITIES_PER_RANGE))
    leaves = placed.select((F.col("position") + (1 << depth)).alias("leaf"), "members")
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(1, depth)))).alias("up")
    above = leaves.select("leaf", "members", steps).select(
        F.call_function("shiftright", "leaf", "up").alias("node"),
        (F.call_function("shiftright", F.col("leaf"), F.col("up") - 1) % 2 == 0).alias("is_left"),
        "members",
    )
    return above.groupBy("node").agg(
        F.sum(F.when(F.col("is_left"), F.col("members")).otherwise(0)).alias("left_members"), F.sum("members").alias("members")
    )


def tree_depth(classes: int) -> int:
    return max(0, (max(1, classes) - 1).bit_length())


def uniform(*parts: str | Column) -> Column:
    """A portable hash of texts as a number strictly between 0 and 1."""
    return (hash32(F.concat_ws(":", *parts)) + 0.5) / HASH_SPACE


def _from_the_mode(mode: np.ndarray, last: np.ndarray, u: np.ndarray, start: np.ndarray, up, down) -> np.ndarray:
    """Inverse transform over outcomes ordered mode, mode + 1, mode - 1, mode + 2, ...: the first whose sum exceeds ``u``.

    ``up(k)`` and ``down(k)`` are the ratios of the probabilities of k + 1 and of k - 1 to that of k.
    """
    out, total = mode.copy(), start.copy()
    high, low, p_high, p_low = mode.copy(), mode.copy(), start.copy(), start.copy()
    open_rows = np.flatnonzero(u >= total)
    while len(open_rows):
        for step, edge, p, ratio in ((1, high, p_high, up), (-1, low, p_low, down)):
            k = edge[open_rows]
            inside = (k < last[open_rows]) if step > 0 else (k > 0)
            p[open_rows] = np.where(inside, p[open_rows] * ratio(open_rows, k), 0.0)
            edge[open_rows] = k + step
            total[open_rows] += p[open_rows]
            done = u[open_rows] < total[open_rows]
            out[open_rows[done]] = edge[open_rows[done]]
            open_rows = open_rows[~done]
        # Nothing is left on either side: rounding left the sum below ``u``.
        open_rows = open_rows[(p_high[open_rows] > 0) | (p_low[open_rows] > 0)]
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    kinds, place = np.unique(n, return_inverse=True)
    return np.array([math.lgamma(k + 1.0) for k in kinds])[place]


def binomial(n: np.ndarray, left: np.ndarray, whole: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial(n, left / whole) numbers by inverse transform of ``u``, some sqrt(n) steps each."""
    p = left / whole
    sure = (p <= 0) | (p >= 1)
    q = np.where(sure, 0.5, p)
    mode = np.minimum(np.floor((n + 1) * q).astype(np.int64), n)
    log_start = _log_factorial(n) - _log_factorial(mode) - _log_factorial(n - mode) + mode * np.log(q) + (n - mode) * np.log1p(-q)
    odds = q / (1 - q)
    found = _from_the_mode(
        mode, n, u, np.exp(log_start),
        lambda i, k: (n[i] - k) / (k + 1) * odds[i],
        lambda i, k: k / np.maximum(n[i] - k + 1, 1) / odds[i],
    )
    return np.where(sure, np.where(p >= 1, n, 0), found)


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers by inverse transform of ``u``, some sqrt(mean) steps each."""
    mode = np.floor(mean).astype(np.int64)
    start = np.exp(mode * np.log(mean) - mean - _log_factorial(mode))
    last = np.full(len(mode), np.iinfo(np.int64).max)
    return _from_the_mode(mode, last, u, start, lambda i, k: mean[i] / (k + 1), lambda i, k: k / mean[i])


def _class_totals(counts: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """Totals per replicate from n draws with replacement, without any rows for draws.

    How often the members of each class are drawn is multinomial. It is drawn down the tree of classes: of the draws of a
    node a binomial number goes left. The work is replicates times classes, whatever the size of the fleet.
    """
    classes = cut(class_table(counts), "classes")
    depth, tree = tree_depth(classes.count()), cut(class_tree(classes), "class-tree")

    @F.pandas_udf("long")
    def goes_left(draws: pd.Series, left: pd.Series, whole: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(binomial(*(s.to_numpy() for s in (draws, left, whole, u))))

    state = counts.sparkSession.range(replicates).select(
        F.col("id").alias("replicate"), F.lit(1).cast("long").alias("node"), F.lit(n).cast("long").alias("draws")
    )
    for level in range(depth):
        if level and level % LEVELS_PER_PLAN == 0:
            state = cut(state, "draws")
        here = state.join(tree, "node")
        u = uniform(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("node").cast("string"))
        split = here.withColumn("left", goes_left("draws", "left_members", "members", u))
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("draws")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("draws") - F.col("left")).alias("draws")),
        )
        state = split.select("replicate", F.inline(sides)).where("draws > 0")
    placed = number_entities(classes.withColumnRenamed("label", ENTITY), -(-max(1, classes.count()) // ENTITIES_PER_RANGE))
    leaves = placed.select((F.col("position") + (1 << depth)).alias("node"), *COUNTS)
    drawn = state.join(leaves, "node")
    return drawn.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("draws")).alias(c) for c in COUNTS])


def _poisson_totals(counts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Totals per replicate with an independent Poisson(1) weight per entity.

    The weights of a class of m entities add up to Poisson(m), so the work is replicates times classes.
    """
    classes = class_table(counts)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    u = uniform(F.lit(str(seed)), F.col("replicate").cast("string"), "label")

    @F.pandas_udf("long")
    def weight(members: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(poisson(members.to_numpy().astype(float), at.to_numpy()))

    drawn = classes.select("*", numbers).withColumn("draws", weight("members", u))
    return drawn.groupBy(F.col("replicate").cast("long").alias("replicate")).agg(
        *[F.sum(F.col(c) * F.col("draws")).alias(c) for c in COUNTS]
    )


def cluster_bootstrap(
    counts: DataFrame,
    replicates: int = 300,
    seed: int = 42,
    method: str = "draws",
    most_broadcast: int = BROADCAST_ENTITIES,
) -> DataFrame:
    """95% percentile intervals of five rates, one row each, from resampled entities.

    The caller chooses the method, at any size: ``draws`` draws n entities with replacement by hash in every
    replicate; ``classes`` draws how often each class of equal entities comes up, which has the same distribution and makes no
    rows for draws; ``poisson`` gives entities Poisson weights. The work of the last two does not grow with the fleet.
    """
    if method not in ("draws", "classes", "poisson"):
        raise ValueError(f"no such method: {method}")
    counts = cut(counts, "entity_counts")
    n = counts.count()
    if n < 2:
        raise ValueError("need at least two entities to resample")
    if method == "draws":
        totals = _hash_draw_totals(counts, n, replicates, seed, most_broadcast)
    elif method == "classes":
        totals = _class_totals(counts, n, replicates, seed)
    else:
        totals = _poisson_totals(counts, replicates, seed)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def at_least_one(c: Column) -> Column:
        return F.greatest(c, F.lit(1))

    rates = totals.select(
        (tp / at_least_one(tp + fp)).alias("precision"),
        (tp / at_least_one(tp + fn)).alias("recall"),
        (fp / at_least_one(fp + tn)).alias("false_positive_rate"),
        ((tp + fp) / at_least_one(tp + fp + fn + tn) * 1000).alias("alerts_per_1000_drive_days"),
        (F.col("detected_events") / at_least_one(F.col("events"))).alias("failure_event_recall"),
    )
    ends = rates.agg(*[F.percentile(r, [0.025, 0.975]).alias(r) for r in RATES])
    pairs = ", ".join(f"'{r}', {r}[0], {r}[1]" for r in RATES)
    return ends.selectExpr(f"stack({len(RATES)}, {pairs}) as (metric, lower_95, upper_95)").orderBy("metric")
