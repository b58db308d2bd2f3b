"""Daily CSV files with changing headers, table sinks, the snapshot and report files."""

from __future__ import annotations

import datetime as dt

import pyarrow.parquet as pq
import pytest

from fleetwatch.plans.stages import Study
from fleetwatch.operators.splits import SplitSpec
from fleetwatch.sources import daily_csv, reports, snapshot, tables
from fleetwatch.session import cut, shared_folder


def _write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_columns_are_aligned_by_name(spark, tmp_path):
    _write(tmp_path, "q1/2020-01-01.csv", 'date,serial_number,smart_5_raw\n2020-01-01,A,7\n2020-01-01,"B,""x""",\n')
    _write(tmp_path, "q2/2020-04-01.csv", 'smart_9_raw,date,serial_number\n5,2020-04-01,A\n"",2020-04-01,C\n')
    _write(tmp_path, "q2/2020-04-02.csv", "smart_9_raw,date,serial_number\n 6 ,2020-04-02,A\n")
    _write(tmp_path, "q2/readme.txt", "not,a,table\n")
    df = daily_csv.read_daily_csv(spark, str(tmp_path))
    assert {t for _, t in df.dtypes} == {"string"} and df.columns[-1] == "filename"
    got = {(r["date"], r["serial_number"]): (r["smart_5_raw"], r["smart_9_raw"]) for r in df.collect()}
    assert got == {
        ("2020-01-01", "A"): ("7", None),
        ("2020-01-01", 'B,"x"'): (None, None),
        ("2020-04-01", "A"): (None, "5"),
        ("2020-04-01", "C"): (None, None),
        ("2020-04-02", "A"): (None, " 6 "),
    }
    names = {r["filename"].rsplit("/", 1)[1] for r in df.collect()}
    assert names == {"2020-01-01.csv", "2020-04-01.csv", "2020-04-02.csv"}


@pytest.mark.parametrize("line", ["2020-01-01", "2020-01-01,A,1,2"])
def test_rows_that_do_not_fit_raise(spark, tmp_path, line):
    _write(tmp_path, "a.csv", f"date,serial_number,failure\n2020-01-01,A,0\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        daily_csv.read_daily_csv(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        daily_csv.read_daily_csv(spark, str(tmp_path)).select("date").collect()


def test_quoted_line_breaks(spark, tmp_path):
    _write(tmp_path, "a.csv", 'date,serial_number\n2020-01-01,"A\nB"\n')
    got = daily_csv.read_daily_csv(spark, str(tmp_path), multi_line=True).collect()
    assert [r["serial_number"] for r in got] == ["A\nB"]


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        daily_csv.read_daily_csv(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        daily_csv.read_daily_csv(spark, str(tmp_path / "nowhere"))


def test_repeated_column(spark, tmp_path):
    _write(tmp_path, "a.csv", "date,date\n1,2\n")
    with pytest.raises(ValueError, match="repeated column"):
        daily_csv.read_daily_csv(spark, str(tmp_path))


def test_table_sink(frame, spark, tmp_path):
    df = frame([(2, "b"), (1, "a")], "day int, v string")
    tables.write_table(df, str(tmp_path / "t"), day="day")
    assert list((tmp_path / "t").glob("*.zstd.parquet"))
    back = tables.open_table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in tables.schema_rows(back).collect()] == [(0, "day", "int"), (1, "v", "string")]
    assert tables.row_count(back).first()[0] == 2
    assert tables.read_rows(back, ["v", "day", "v"], "day = 1").columns == ["v", "day"]


def test_feature_names():
    columns = ["date", "capacity_bytes", "smart_5_raw_num", "model", "smart_5_raw_num", "serial_number"]
    assert tables.feature_columns(columns) == (["capacity_bytes", "smart_5_raw_num"], ["model"])
    assert tables.feature_columns(["date"]) == ([], [])


def test_snapshot(frame):
    rows = [("2020-01-01", "A", "M", "1", "1", "5"), ("2020-01-02", "A", "M", "1000", "1", "x"), ("bad", "B", "M", "1", "0", "1")]
    df = snapshot.latest_snapshot(frame(rows, "date string, serial_number string, model string, capacity_bytes string, failure string, smart_5_raw string"))
    got = df.collect()
    assert len(df.columns) == 12 and len(got) == 1
    assert (str(got[0]["date"]), got[0]["failure"], got[0]["capacity_bytes"], got[0]["smart_5_raw"]) == ("2020-01-02", True, 1000.0, None)


def test_snapshot_of_a_table_by_day_reads_one_day(spark, frame, tmp_path):
    rows = [(f"2020-01-{d:02d}", f"S{i}", "M", str(d), "0") for d in range(1, 10) for i in range(3)] + [("bad", "B", "M", "1", "0")]
    df = frame(rows, "date string, serial_number string, model string, capacity_bytes string, failure string")
    path = str(tmp_path / "days")
    tables.write_days(df, path)
    assert tables.newest_day(spark, path) == dt.date(2020, 1, 9)
    found = snapshot.stored_snapshot(spark, path, df.schema)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, snapshot.latest_snapshot(df).collect()))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day_of" in plan and "DataFilters: []" in plan
    assert tables.open_days(spark, path, df.schema).count() == len(rows)
    empty = str(tmp_path / "none")
    tables.write_days(df.limit(0), empty)
    assert tables.newest_day(spark, empty) is None and snapshot.stored_snapshot(spark, empty, df.schema).count() == 0


def test_one_drive_is_in_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "HISTORY_BLOCK", 50_000)
    df = spark.range(200_000).selectExpr(
        "concat('D', lpad(cast(id % 5000 as string), 5, '0')) as serial_number",
        "date_add(date'2020-01-01', cast(id div 5000 as int)) as obs_date", "rand(1) as risk_x")
    tables.write_histories(df, str(tmp_path / "h"), "serial_number", "obs_date")
    files = [pq.ParquetFile(f) for f in (tmp_path / "h").glob("*.parquet")]
    holds = lambda g: g.column(0).statistics.min <= "D01234" <= g.column(0).statistics.max
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 8 and sum(map(holds, groups)) <= 2
    back = tables.open_table(spark, str(tmp_path / "h")).where("serial_number = 'D01234'")
    assert back.count() == 40 and "EqualTo(serial_number,D01234)" in back._jdf.queryExecution().toString()


def test_metric_files(frame, spark, tmp_path):
    rows = [("x", "test", "recall", 0.5), ("x", "test", "median_lead_days_detected_events", None)]
    tidy = frame(rows, reports.METRIC_SCHEMA)
    reports.write_metrics(tidy, str(tmp_path / "r"))
    assert {r["metric"]: r["value"] for r in reports.read_metrics(spark, str(tmp_path / "r")).collect()} == {
        "recall": 0.5, "median_lead_days_detected_events": None
    }
    wide = spark.read.option("header", "true").csv(str(tmp_path / "r/metrics_csv"))
    assert wide.first()["test_recall"] == "0.5"


def test_records(frame, spark, tmp_path):
    df = frame([(None, 1)], "day date, v int").selectExpr("date'2020-01-02' as at", "day", "v")
    reports.write_records(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert text.strip() == '{"at":"2020-01-02","day":null,"v":1}'


def test_cut_keeps_rows_and_uses_the_shared_folder(frame):
    df = frame([(1, None), (2, "b")], "i int, v string")
    made = cut(df, "cut_test")
    assert sorted(map(tuple, made.collect())) == [(1, None), (2, "b")]
    assert all(shared_folder(df.sparkSession) in f for f in made.inputFiles())


def test_a_study_of_csv_files(spark, tmp_path):
    """From files to metrics without any event log."""
    lines = {}
    for i in range(24):
        for day in range(1, 29):
            fails = i % 3 == 0 and day == 8 + (i * 5) % 20
            if i % 3 == 0 and day > 8 + (i * 5) % 20:
                continue
            wear = day * (i % 3 == 0) + i
            lines.setdefault(day, []).append(f"2020-01-{day:02d},S{i},M{i % 2},1000,{int(fails)},{wear},{day},{wear}")
    for day, rows in lines.items():
        header = "date,serial_number,model,capacity_bytes,failure,smart_5_raw,smart_9_raw,smart_197_raw\n"
        _write(tmp_path, f"2020-01-{day:02d}.csv", header + "\n".join(rows) + "\n")
    spec = SplitSpec("2020-01-14", "2020-01-21", "2020-01-28", horizon_days=3)
    # The 17 training rows have a hessian of 7 in all.
    study = Study.from_daily_csv(spark, str(tmp_path), spec, horizon_days=3, least_hessian=0.2)
    tidy = study.learned_metrics()
    models = {r["model"] for r in tidy.select("model").distinct().collect()}
    assert models == {"logistic_regression", "boosted_trees", "isolation_forest", "sector_count_rule"}
    values = {(r["model"], r["metric"]): r["value"] for r in tidy.where("split = 'validation'").collect()}
    # The wear of failing devices grows from day to day, which the learners can see.
    base = values["logistic_regression", "prevalence"]
    assert values["logistic_regression", "average_precision"] > 2 * base
    assert values["boosted_trees", "average_precision"] > 2 * base
    for m in models:
        assert values[m, "false_positive_rate"] <= 0.01
