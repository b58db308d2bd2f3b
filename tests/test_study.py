"""What a study keeps between its stages, and the tables that it leaves."""

from __future__ import annotations

import os

from fleetwatch.models.boosting import Boosting
from fleetwatch.plans import stages
from fleetwatch.plans.stages import Study
from fleetwatch.session import cut, mark, release, shared_folder

FLEET = "date string, serial_number string, model string, capacity_bytes string, failure string, smart_5_raw string"


def _source(frame, n):
    return lambda: frame([(f"2024-01-{d:02d}", "A", "M", "1", "0", "1") for d in range(1, n + 1)], FLEET)


def test_studies_of_one_folder_keep_their_own_data(spark, frame, tmp_path):
    seven, two = (Study(spark, str(tmp_path), source=_source(frame, n)) for n in (7, 2))
    assert (seven.stored_raw().count(), two.stored_raw().count()) == (7, 2)
    assert seven.stored_raw().count() == 7


def test_a_changed_folder_is_read_again(spark, frame, tmp_path):
    path = str(tmp_path / "events.parquet")
    frame([(1,)], "x int").write.parquet(path)
    before = Study(spark, str(tmp_path))._key("raw")
    assert Study(spark, str(tmp_path))._key("raw") == before
    frame([(1,)], "x int").write.parquet(str(tmp_path / "more.parquet"))
    assert Study(spark, str(tmp_path))._key("raw") != before


def test_every_parameter_is_part_of_the_key(spark, tmp_path):
    made = [
        Study(spark, str(tmp_path)),
        Study(spark, str(tmp_path), rounds=7),
        Study(spark, str(tmp_path), healthy_fraction=0.5),
        Study(spark, str(tmp_path), forest_fraction=0.5),
        Study(spark, str(tmp_path), horizon_days=9),
        Study(spark, str(tmp_path), least_hessian=1.0),
        Study.from_daily_csv(spark, str(tmp_path), stages.SPLIT, stages.HORIZON),
    ]
    assert len({s._key("scorers") for s in made}) == len(made)
    again = Study.from_daily_csv(spark, str(tmp_path), stages.SPLIT, stages.HORIZON)
    assert again._key("raw") == made[-1]._key("raw")
    assert again.healthy_fraction == again.forest_fraction == 0.1


def test_the_learner_gets_the_rounds_of_the_study(spark, monkeypatch, tmp_path):
    asked = []
    for name, value in (("prepared", lambda s, split: None), ("training", lambda s: None)):
        monkeypatch.setattr(Study, name, value)
    monkeypatch.setattr(Study, "_stage", lambda s, name, build, day=None: None)
    monkeypatch.setattr(stages, "check_classes", lambda *a: None)
    monkeypatch.setattr(stages, "fit_logistic", lambda rows: None)
    monkeypatch.setattr(stages, "fit_boosted", lambda rows, held_out, rounds, least_hessian: asked.append(rounds))
    Study(spark, str(tmp_path)).scorers()
    Study(spark, str(tmp_path), rounds=3).scorers()
    assert asked == [Boosting().rounds, 3] and Boosting().rounds == 180


def test_release_deletes_what_was_cut(spark, frame):
    folder = shared_folder(spark).removeprefix("file:")
    before = mark(spark)
    kept = cut(frame([(1,)], "x int"), "kept")
    path = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    middle = mark(spark)
    gone = cut(frame([(2,)], "x int"), "gone").inputFiles()[0].rpartition("/")[0].rpartition("/")[2]
    assert gone in os.listdir(folder)
    release(spark, middle)
    assert mark(spark) == middle == before + 1
    assert gone not in os.listdir(folder) and os.path.isdir(path) and kept.count() == 1
    release(spark, before)
    assert not os.path.isdir(path)
