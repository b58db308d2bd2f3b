"""Boosting by histograms: leaf values by SQL, weights in the hessian, patience, repeatability, stored models."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fleetwatch.models import boosting
from fleetwatch.models.boosting import LEAF, Boosting, fit_boosted_trees

SCHEMA = "serial_number string, obs_date date, will_fail_30d int, sample_weight double, x array<double>"
WEIGHT = "sample_weight"


def _rows(n=600, seed=1, heavy=1.0):
    import datetime as dt

    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1), float(rng.randrange(5)), rng.random(), float(rng.random() < 0.1)]
        y = int(x[0] + 0.5 * x[1] + rng.gauss(0, 0.7) > 2)
        out.append((f"D{i % 97}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 97), y, 1.0 if y else heavy, x))
    return out


def _frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumn("features", array_to_vector("x"))


def _arrays(rows):
    return np.array([r[4] for r in rows]), np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])


@pytest.fixture(scope="module")
def model(spark):
    chosen = Boosting(rounds=4, depth=3, rate=0.3, rows=1.0, columns=1.0, least_hessian=5.0, bins=16)
    return fit_boosted_trees(_frame(spark, _rows()), None, WEIGHT, chosen=chosen)


def test_leaf_values_by_sql(spark, model, tmp_path):
    """Values of all leaves of all trees, recomputed by SQL from a table of (row, tree, leaf)."""
    rows = _rows()
    x, y, _ = _arrays(rows)
    bins = boosting._binned(x, model.edges)
    table = [
        (i, t, int(leaf), int(y[i]))
        for t, tree in enumerate(model.trees)
        for i, leaf in enumerate(tree.leaf_of(bins, model.depth))
    ]
    path = str(tmp_path / "leaves")
    spark.createDataFrame(table, "row int, tree int, leaf int, y int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create table placed as select * from read_parquet('{path}/*.parquet')")
    con.execute("create table value (tree int, leaf int, v double)")
    for t in range(len(model.trees)):
        con.execute(
            f"""insert into value
            with m as (select a.row, a.y, {model.base!r} + coalesce(sum(v.v), 0) as m from placed a
                       left join value v on v.tree = a.tree and v.leaf = a.leaf and a.tree < {t} group by a.row, a.y),
                 p as (select row, y, 1 / (1 + exp(-m)) as p from m)
            select {t}, leaf, -sum(p - p.y) / (sum(p * (1 - p)) + 2) * 0.3
            from p join placed on p.row = placed.row and placed.tree = {t} group by leaf"""
        )
    found = dict(((t, leaf), v) for t, leaf, v in con.execute("select * from value").fetchall())
    want = {(t, k): tree.value[k] for t, tree in enumerate(model.trees) for k in tree.nodes() if tree.feature[k] == LEAF}
    assert found.keys() == want.keys() and len(want) > 16
    assert all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_first_split_is_the_best_of_all(model):
    x, y, _ = _arrays(_rows())
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def score(own):
        return g[own].sum() ** 2 / (h[own].sum() + 2)

    best = max(
        (score(x[:, f] <= e) + score(x[:, f] > e) - score(slice(None)), -f, -e)
        for f, edges in enumerate(model.edges)
        for e in edges
        if min(h[x[:, f] <= e].sum(), h[x[:, f] > e].sum()) >= 5
    )
    tree = model.trees[0]
    assert (tree.feature[1], model.threshold(tree, 1)) == (-best[1], -best[2])
    assert tree.gain[1] == pytest.approx(best[0], rel=1e-9)


def test_edges_are_quantiles_of_the_rows(spark, model):
    x, _, _ = _arrays(_rows())
    for f, edges in enumerate(model.edges):
        values = np.sort(x[:, f])
        ends = {values[math.ceil(k * len(values) / 16) - 1] for k in range(1, 17)} - {values[-1]}
        assert edges.tolist() == sorted(ends)
    ranged = boosting.quantile_edges(_frame(spark, _rows()), 16, rows_per_range=50)
    assert [e.tolist() for e in ranged] == [e.tolist() for e in model.edges]


def test_the_least_hessian_counts_weight_not_rows(spark):
    """17 rows: too few by number, enough by weight."""
    rows = [(f"D{i}", None, int(i < 8), 1.0 if i < 8 else 10.0, [float(i >= 8), 0.0]) for i in range(17)]
    df = _frame(spark, rows)
    heavy = fit_boosted_trees(df, None, WEIGHT, chosen=Boosting(rounds=1, least_hessian=0.5, rows=1.0, columns=1.0))
    assert heavy.trees[0].feature[1] == 0
    light = df.withColumn(WEIGHT, F.lit(0.1))
    same = fit_boosted_trees(light, None, WEIGHT, chosen=Boosting(rounds=1, least_hessian=0.5, rows=1.0, columns=1.0))
    assert same.trees[0].feature[1] == LEAF


def test_equal_trees_for_any_partitions(spark):
    chosen = Boosting(rounds=3, depth=3, rate=0.3, least_hessian=3.0)
    held_out = _frame(spark, _rows(300, 2))
    found = [
        fit_boosted_trees(_frame(spark, _rows(heavy=10.0), parts), held_out.repartition(parts), WEIGHT, chosen=chosen)
        for parts in (1, 7)
    ]
    assert boosting.node_rows(found[0]) == boosting.node_rows(found[1])
    assert found[0].history == found[1].history and len(found[0].history) == 3


def test_sums_of_many_tasks_are_added_before_the_driver(spark, monkeypatch):
    chosen = Boosting(rounds=2, depth=3, rate=0.3, least_hessian=3.0)
    df = _frame(spark, _rows())
    few = fit_boosted_trees(df, None, WEIGHT, chosen=chosen)
    monkeypatch.setattr(boosting, "ROWS_PER_FILE", 90)
    monkeypatch.setattr(boosting, "DIRECT_TASKS", 2)
    assert boosting.node_rows(fit_boosted_trees(df, None, WEIGHT, chosen=chosen)) == boosting.node_rows(few)


def test_patience():
    assert boosting.best_round([0.1, 0.3, 0.3, 0.2]) == 2
    assert not boosting._worn_out([0.3, 0.2, 0.2], 3)
    assert boosting._worn_out([0.1, 0.3, 0.2, 0.2, 0.2], 3)
    assert boosting._worn_out([0.3, 0.2, 0.2, 0.2, 0.9], 3)


def test_validation_ends_boosting_and_keeps_the_best_round(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 2)
    noise = _frame(spark, _rows(300, 5)).withColumn("will_fail_30d", (F.xxhash64("serial_number", "obs_date") % 2 == 0).cast("int"))
    chosen = Boosting(rounds=12, depth=2, rate=0.3, least_hessian=3.0, patience=3)
    model = fit_boosted_trees(_frame(spark, _rows()), noise, WEIGHT, chosen=chosen)
    assert model.best == boosting.best_round(model.history) and len(model.kept()) == model.best
    assert len(model.trees) == 12 or boosting._worn_out(model.history, 3)
    x, _, _ = _arrays(_rows(50, 9))
    scored = _frame(spark, _rows(50, 9)).select("x", model.probability(F.col("features")).alias("p")).collect()
    want = {tuple(r): p for r, p in zip(x, 1 / (1 + np.exp(-model.margins(x))))}
    assert all(r["p"] == pytest.approx(want[tuple(r["x"])], abs=1e-12) for r in scored)


def test_a_stored_model_is_the_same(spark, model, tmp_path):
    boosting.save_trees(str(tmp_path / "m"), model)
    again = boosting.load_trees(str(tmp_path / "m"))
    assert boosting.node_rows(again) == boosting.node_rows(model)
    x, _, _ = _arrays(_rows(40, 3))
    assert (again.margins(x) == model.margins(x)).all() and again.best == model.best


def test_wrong_inputs(spark):
    df = _frame(spark, _rows(40))
    with pytest.raises(ValueError, match="both labels"):
        fit_boosted_trees(df.where("will_fail_30d = 0"), None, WEIGHT)
    with pytest.raises(ValueError, match="one byte"):
        fit_boosted_trees(df, None, WEIGHT, chosen=Boosting(bins=300))


@pytest.mark.parametrize("rows_per_file", [90, 100_000])
def test_the_driver_gets_splits_not_histograms(spark, monkeypatch, rows_per_file):
    """A level sends one row per node and feature, for one file of rows and for many."""
    frame = _frame(spark, _rows())
    sent, to_arrow = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda df: sent.append(to_arrow(df)) or sent[-1])
    monkeypatch.setattr(boosting, "ROWS_PER_FILE", rows_per_file)
    chosen = Boosting(rounds=1, depth=3, rate=0.3, rows=1.0, columns=1.0, least_hessian=3.0)
    fit_boosted_trees(frame, None, WEIGHT, chosen=chosen)
    assert len(sent) == 3 and all(t.num_rows <= 4 << level for level, t in enumerate(sent))
