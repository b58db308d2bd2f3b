"""Preprocessing, scorers, forest and attributions: contracts and brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fleetwatch.models import attribution, bundle, forest, prep, scorers

DAY = dt.date(2020, 1, 1)
SCHEMA = (
    "obs_date date, serial_number string, model string, failure_date date, will_fail_30d int, "
    "capacity_bytes double, smart_5_raw_num double, smart_197_raw_num double, sample_weight double"
)
NUMERIC = ["capacity_bytes", "smart_5_raw_num", "smart_197_raw_num"]


def _rows(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(a + 0.7 * a * b + rng.gauss(0, 0.5) > 0.8)
        out.append((DAY + dt.timedelta(days=i % 20), f"D{i}", rng.choice(["M1", "M2", None]), None, y,
                    float(rng.randint(1, 4)), a if rng.random() > 0.1 else None, b, 1.0 if y else 2.0))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    p = prep.fit_prep(df)
    prepared = prep.prepare(df, p).persist()
    models = {
        "logistic_regression": scorers.fit_logistic(prepared),
        "boosted_trees": scorers.fit_boosted(prepared, rounds=6, depth=4, rate=0.3, least_hessian=2.0),
    }
    yield df, p, prepared, models
    prepared.unpersist()


def test_vectors(fitted, frame):
    df, p, prepared, _ = fitted
    assert prepared.columns == [*df.columns, "features"]
    assert prep.vector_names(p, NUMERIC) == [*NUMERIC, "model_M1", "model_M2"]
    x = np.array([r[0] for r in prepared.select(vector_to_array("features")).collect()])
    assert x.shape == (240, 5) and not np.isnan(x).any()
    # Standardised numbers: mean 0 and sample deviation 1.
    assert np.allclose(x[:, :3].mean(axis=0), 0, atol=1e-9) and np.allclose(x[:, :3].std(axis=0, ddof=1), 1)
    assert set(map(tuple, x[:, 3:])) == {(1.0, 0.0), (0.0, 1.0)}
    new = frame([(DAY, "N", "unknown", None, 0, 1.0, None, 0.0, 1.0)], SCHEMA)
    one = np.array(prep.prepare(new, p).select(vector_to_array("features")).first()[0])
    assert one[3:].tolist() == [0.0, 0.0]


def test_missing_numbers_get_the_median(fitted, frame):
    df, p, _, _ = fitted
    known = sorted(r[0] for r in df.select("smart_5_raw_num").dropna().collect())
    median = known[(len(known) - 1) // 2]
    rows = [(DAY, "N", "M1", None, 0, 1.0, v, 0.0, 1.0) for v in (None, median)]
    made = [r[0] for r in prep.prepare(frame(rows, SCHEMA), p).select(vector_to_array("features")).collect()]
    assert made[0][1] == pytest.approx(made[1][1], abs=0.05)


def test_most_frequent_text(frame):
    df = frame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "m string")
    assert prep.most_frequent(df, "m") == "a"
    assert prep.most_frequent(df.where("m is null"), "m") is None


def test_scores(fitted):
    _, _, prepared, models = fitted
    got = scorers.score_holdout(prepared, models)
    assert got.columns == ["obs_date", "serial_number", "model", "failure_date", "will_fail_30d",
                           "risk_logistic_regression", "risk_boosted_trees", "risk_sector_count_rule"]
    rows = got.collect()
    for name in ("risk_logistic_regression", "risk_boosted_trees"):
        assert all(0 <= r[name] <= 1 for r in rows)
        good = np.mean([r[name] for r in rows if r["will_fail_30d"]])
        assert good > np.mean([r[name] for r in rows if not r["will_fail_30d"]]) + 0.05


def test_logistic_regression_is_at_its_optimum(fitted):
    """The gradient of the weighted loss with the L2 penalty vanishes at the fitted coefficients."""
    _, _, prepared, models = fitted
    model = models["logistic_regression"]
    rows = prepared.select(vector_to_array("features"), "will_fail_30d", "sample_weight").collect()
    x, y, w = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
    beta, b = np.array(model.coefficients), model.intercept
    off = w * (1 / (1 + np.exp(-(x @ beta + b))) - y)
    assert np.abs(x.T @ off + beta).max() < 0.05 and abs(off.sum()) < 0.05


def test_class_checks(frame):
    df = frame(_rows(20), SCHEMA)
    scorers.check_classes(df, "train")
    with pytest.raises(ValueError, match="both classes"):
        scorers.check_classes(df.where("will_fail_30d = 0"), "train")
    scorers.check_classes(df.where("will_fail_30d = 0"), "healthy", both=False)
    with pytest.raises(ValueError, match="non-empty"):
        scorers.check_classes(df.limit(0), "train")
    with pytest.raises(ValueError, match="non-empty"):
        scorers.check_classes(df.withColumn("will_fail_30d", F.lit(2)), "train")


def test_bundle(fitted, tmp_path):
    df, p, prepared, models = fitted
    for name, model in models.items():
        bundle.save_bundle(str(tmp_path / name), p, model, NUMERIC)
        again = bundle.load_bundle(str(tmp_path / name))
        assert again.numeric == NUMERIC
        a = {r["serial_number"]: r[f"risk_{name}"] for r in scorers.score_holdout(prepared, {name: model}).collect()}
        b = {r["serial_number"]: r["risk_x"] for r in again.score(df, "x").collect()}
        assert a == pytest.approx(b, abs=1e-12)
        with pytest.raises(ValueError, match="differ"):
            again.score(df.drop("capacity_bytes"), "x")


def test_forest_finds_the_odd_row(fitted, spark):
    _, p, prepared, _ = fitted
    grown = forest.fit_isolation_forest(prepared.where("will_fail_30d = 0"), trees=40, rows_per_tree=64, seed=1)
    odd = spark.createDataFrame([(DAY, "odd", "M1", None, 0, 2.0, 60.0, -70.0, 1.0)], SCHEMA)
    both = prep.prepare(odd, p).unionByName(prepared)
    got = {r["serial_number"]: r["anomaly_score"] for r in forest.score_batches(both, grown).collect()}
    # The trees have not seen it, so it can at most share the shortest paths with their own edge rows.
    assert got["odd"] > np.quantile(list(got.values()), 0.98)
    assert -0.5 < min(got.values()) and max(got.values()) < 0.5


def test_forest_is_repeatable_and_bounded(fitted):
    _, _, prepared, _ = fitted
    a, b = (forest.fit_isolation_forest(prepared, trees=10, rows_per_tree=32, seed=5) for _ in range(2))
    rows = [sorted(map(tuple, f.nodes.collect())) for f in (a, b)]
    assert rows[0] == rows[1]
    per_tree = {r["tree"]: r["n"] for r in a.nodes.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert set(per_tree) == set(range(10)) and max(per_tree.values()) <= 63
    assert a.nodes.where("feature < 0").agg(F.max("path")).first()[0] <= 5 + forest.average_path(32)


def test_tree_samples_are_bounded_also_for_copies(spark):
    """Equal rows have row ids of their own, so no tree gets more than its share of them."""
    same = spark.range(20_000).select(F.lit(1.0).alias("v")).repartition(4)
    from pyspark.ml.feature import VectorAssembler

    prepared = VectorAssembler(inputCols=["v"], outputCol="features").transform(same)
    sizes = forest.tree_samples(prepared, 8, 64, 3).groupBy("tree").count().collect()
    assert len(sizes) == 8 and all(64 <= r["count"] <= 64 * 2 * 2 for r in sizes)


def test_a_tree_gets_the_smallest_draws_of_all_rows(spark):
    import hashlib

    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(900).selectExpr("date'2024-01-01' as obs_date", "concat('D', id) as serial_number", "double(id) as v")
    prepared = VectorAssembler(inputCols=["v"], outputCol="features").transform(rows)
    draw = lambda key, tree: int(hashlib.md5(f"{key}:3:{tree}".encode()).hexdigest()[:8], 16)
    keys = [f"D{i}:2024-01-01" for i in range(900)]
    for settings in ({}, {"overdraw": 0.25}):  # also where a tree gets too few at first
        found = forest.tree_samples(prepared, 5, 16, 3, **settings).collect()
        for tree in range(5):
            own = sorted((r["draw"], r["key"]) for r in found if r["tree"] == tree)[:16]
            assert [k for _, k in own] == sorted(keys, key=lambda k: draw(k, tree))[:16]


def test_average_path():
    assert [forest.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.average_path(512) == pytest.approx(2 * (math.log(511) + 0.5772156649) - 2 * 511 / 512)


def test_forest_needs_rows(fitted):
    _, _, prepared, _ = fitted
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_isolation_forest(prepared.limit(0))


def _value_of(leaves, x, known):
    """Expected margin when only the features in ``known`` are known."""
    total = 0.0
    for leaf in leaves:
        part = leaf["value"]
        for f, (low, high, share) in leaf["limits"].items():
            part *= float(low < x[f] <= high) if f in known else share
        total += part
    return total


def test_boosted_attribution_equals_subset_enumeration(fitted):
    _, _, prepared, models = fitted
    model = models["boosted_trees"]
    leaves = attribution.tree_paths(model)
    explained = attribution.attribute(prepared.limit(6), model)
    rows = explained.select(vector_to_array("features").alias("x"), "contributions", "base_value", "margin").collect()
    n = len(rows[0]["x"])
    for r in rows:
        for i in range(n):
            others = [j for j in range(n) if j != i]
            phi = 0.0
            for k in range(n):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                for s in itertools.combinations(others, k):
                    phi += weight * (_value_of(leaves, r["x"], {*s, i}) - _value_of(leaves, r["x"], set(s)))
            assert r["contributions"][i] == pytest.approx(phi, abs=1e-9)
        assert r["base_value"] + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-9)


def test_boosted_margin_is_that_of_the_model(fitted):
    _, _, prepared, models = fitted
    model = models["boosted_trees"]
    explained = attribution.attribute(prepared, model).select("serial_number", "margin")
    scored = scorers.score_holdout(prepared, {"b": model}).select("serial_number", "risk_b")
    for r in explained.join(scored, "serial_number").collect():
        assert r["risk_b"] == pytest.approx(1 / (1 + math.exp(-r["margin"])), abs=1e-9)


def test_logistic_attribution_adds_up(fitted):
    _, _, prepared, models = fitted
    model = models["logistic_regression"]
    rows = attribution.attribute(prepared, model, prepared).select("contributions", "base_value", "margin").collect()
    for r in rows:
        assert r["base_value"] + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-9)
    # Over the background the contributions average out.
    assert np.allclose(np.mean([r["contributions"] for r in rows], axis=0), 0, atol=1e-9)


def test_importance_and_top_features(frame):
    df = frame([([1.0, -3.0, 0.5],), ([1.0, 2.0, -9.0],)], "contributions array<double>")
    names = ["a", "b", "c"]
    assert [tuple(r) for r in attribution.global_importance(df, names, 2).collect()] == [("c", 4.75), ("b", 2.5)]
    top = attribution.top_contributors(df, names, 2).collect()
    assert [(r["top_feature_1"], r["top_feature_2"]) for r in top] == [("b", "a"), ("c", "b")]
    assert attribution.top_contributors(df, names, 5).first()["top_feature_5"] is None


def test_picked_cases(frame):
    rows = [(DAY, f"D{i}", None, y, s) for i, (y, s) in enumerate([(1, 0.9), (1, 0.8), (1, 0.3), (1, 0.2), (0, 0.7), (0, 0.95), (0, 0.1)])]
    df = frame(rows, "obs_date date, serial_number string, failure_date date, will_fail_30d int, risk double")
    got = {r["case_type"]: r["serial_number"] for r in attribution.pick_cases(df, "risk", 0.5).collect()}
    assert got == {"detected_failure": "D0", "missed_failure": "D3", "false_alarm": "D5"}
    assert {r["case_type"] for r in attribution.pick_cases(df, "risk", 2.0).collect()} == {"missed_failure"}


def test_medians_are_exact_at_every_range_size(frame):
    rows = [(float(v), None if v % 3 else float(v * v), None) for v in (9, 1, 4, 6, 6, 12, 30)]
    df = frame(rows, "a double, b double, c double")
    for size in (500_000, 1, 2):
        assert prep.exact_medians(df, ["a", "b", "c"], size) == {"a": 6.0, "b": 81.0, "c": 0.0}
    assert prep.exact_medians(df.where("a > 6"), ["a"]) == {"a": 12.0}


def test_forest_does_not_depend_on_partitions(frame):
    rows = [([float(i % 17), float(i * i % 29)],) for i in range(300)]
    df = frame(rows, "x array<double>").select(array_to_vector("x").alias("features"))
    nodes = [
        sorted(map(tuple, forest.fit_isolation_forest(df.repartition(n), trees=4, rows_per_tree=16).nodes.collect()))
        for n in (2, 8)
    ]
    assert nodes[0] == nodes[1]


def test_a_saved_forest_outlives_its_tables(spark, frame, tmp_path):
    df = frame(_rows(), SCHEMA)
    fitted = prep.fit_prep(df)
    grown = forest.fit_isolation_forest(prep.prepare(df, fitted), trees=5, rows_per_tree=32)
    bundle.save_forest(str(tmp_path / "f"), fitted, grown, NUMERIC)
    loaded = bundle.load_forest(str(tmp_path / "f"))
    before = forest.score_isolation(prep.prepare(df, fitted), grown).select("anomaly_score").collect()
    assert sorted(before) == sorted(loaded.score(df).select("anomaly_score").collect())
    assert loaded.forest.nodes.inputFiles()[0].find("/f/nodes") > 0
    with pytest.raises(ValueError, match="differ"):
        loaded.score(df.drop("smart_5_raw_num"))
