"""The stages of a study as stored tables: each is built once per session and data folder.

A stage is written to the shared folder, so later queries scan only the columns and days they need, and
a lost executor costs a re-read, not a re-run of everything before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwatch.functions.scores import rule_score
from fleetwatch.models.forest import Forest, fit_isolation_forest, score_isolation
from fleetwatch.models.prep import fit_prep, prepare
from fleetwatch.models.boosting import Boosting
from fleetwatch.models.bundle import require_features
from fleetwatch.models.scorers import RULE, check_classes, fit_boosted, fit_logistic, score_holdout
from fleetwatch.operators.features import build_features
from fleetwatch.operators.labels import LABEL, horizon_labels
from fleetwatch.operators.metrics import evaluate_scores, thresholds_at_fpr
from fleetwatch.operators.review import stack_tables
from fleetwatch.operators.sampling import drilldown_sample, sample_healthy, sample_training
from fleetwatch.operators.splits import TEST, TRAIN, VALIDATION, SplitSpec, split_frames
from fleetwatch.session import cut, new_path, shared_folder
from fleetwatch.sources import runs
from fleetwatch.sources.daily_csv import read_daily_csv
from fleetwatch.sources.event_fleet import fleet_from_events
from fleetwatch.sources.snapshot import stored_snapshot
from fleetwatch.sources.tables import DAY_OF, feature_columns, open_days, open_table, write_days, write_histories, write_table

HORIZON = 3
SPLIT = SplitSpec(
    train_end="2024-01-16",
    validation_start="2024-01-16",
    validation_end="2024-01-23",
    test_start="2024-01-23",
    test_end="2024-01-30",
    horizon_days=HORIZON,
)
# Scorers that need no training; the last two are plain ratios with few and with many ties.
PLAIN_SCORERS = (RULE, "load_index", "wear_index")
LOAD_HALF, WEAR_HALF = 5000.0, 3.0
ANOMALY, FOREST = "anomaly_isolation_forest", "isolation_forest"

ROUNDS = Boosting.rounds
HEALTHY_FRACTION = 0.1

_written: dict[tuple, str] = {}
_fitted: dict[tuple, object] = {}


@dataclass(frozen=True)
class _DailyCsv:
    """A source that is equal for equal folders."""

    root: str

    def __call__(self, spark: SparkSession) -> DataFrame:
        return read_daily_csv(spark, self.root)


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in the folder; empty where there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ()
    listed = files.listStatus(at)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed))


@dataclass
class Study:
    """All stages of one data folder.

    By default the telemetry comes from the folder's event log; ``source`` gives any other raw table.

    ``rounds`` is the number of boosting rounds, at most: it ends when average precision on validation stops rising.
    ``healthy_fraction`` and ``forest_fraction`` are the shares of entities whose healthy rows train the scorers
    and the forest. ``least_hessian`` is what boosting asks of both sides of a split; a fleet with fewer than some hundred
    weighted rows cannot be split at all with the usual value.
    """

    spark: SparkSession
    folder: str
    horizon_days: int = HORIZON
    split: SplitSpec = field(default_factory=lambda: SPLIT)
    source: Callable[[], DataFrame] | None = None
    rounds: int = ROUNDS
    healthy_fraction: float = 1.0
    forest_fraction: float = 1.0
    least_hessian: float = Boosting.least_hessian

    @classmethod
    def from_daily_csv(
        cls,
        spark: SparkSession,
        root: str,
        split: SplitSpec,
        horizon_days: int = 30,
        rounds: int = ROUNDS,
        healthy_fraction: float = HEALTHY_FRACTION,
        forest_fraction: float = HEALTHY_FRACTION,
        least_hessian: float = Boosting.least_hessian,
    ) -> Study:
        """A study of the daily CSV files below a folder."""
        read = _DailyCsv(root)
        return cls(
            spark,
            root,
            horizon_days,
            split,
            lambda: read(spark),
            rounds,
            healthy_fraction,
            forest_fraction,
            least_hessian,
        )._named(read)

    def _named(self, source: object) -> Study:
        self._source_key = source
        return self

    def _key(self, name: str) -> tuple:
        """Everything a stage depends on: the application, all parameters, and the input files as they are now."""
        return (
            shared_folder(self.spark),
            self.folder,
            _stamp(self.spark, self.folder),
            getattr(self, "_source_key", self.source),
            self.horizon_days,
            self.split,
            self.rounds,
            self.healthy_fraction,
            self.forest_fraction,
            self.least_hessian,
            name,
        )

    def _stage(self, name: str, build: Callable[[], DataFrame], day: str | None = None) -> DataFrame:
        key = self._key(name)
        if key not in _written:
            path = new_path(self.spark, name)
            write_table(build(), path, day)
            _written[key] = path
        return open_table(self.spark, _written[key])

    def _once(self, name: str, build: Callable[[], object]):
        key = self._key(name)
        if key not in _fitted:
            _fitted[key] = build()
        return _fitted[key]

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events.parquet")

    def raw(self) -> DataFrame:
        """Daily telemetry, not stored."""
        return self.source() if self.source else fleet_from_events(self.events())

    def _raw_days(self) -> tuple[str, StructType]:
        """Path and schema of the stored telemetry, a table by day."""

        def build() -> tuple[str, StructType]:
            raw, path = self.raw(), new_path(self.spark, "raw")
            write_days(raw, path, rebalance=self.source is None)
            return path, raw.schema

        return self._once("raw", build)

    def stored_raw(self) -> DataFrame:
        return open_days(self.spark, *self._raw_days()).drop(DAY_OF)

    def snapshot(self) -> DataFrame:
        """The newest day of the telemetry; no other day is read."""
        return stored_snapshot(self.spark, *self._raw_days())

    def labeled(self) -> DataFrame:
        return self._stage("labeled", lambda: horizon_labels(self.stored_raw(), self.horizon_days))

    def features(self) -> DataFrame:
        return self._stage(
            "features", lambda: build_features(self.stored_raw(), horizon_days=self.horizon_days), "obs_date"
        )

    def splits(self) -> dict[str, DataFrame]:
        return split_frames(self.features(), self.split)

    def plain_predictions(self) -> DataFrame:
        """Validation and test rows with the scores that need no training."""

        def build() -> DataFrame:
            load = F.coalesce("smart_194_mean_7d", F.lit(0.0))
            wear = F.coalesce("smart_9_max_7d", F.lit(0.0))
            parts = [self.splits()[s].withColumn("split", F.lit(s)) for s in (VALIDATION, TEST)]
            return parts[0].unionByName(parts[1]).select(
                "obs_date",
                "serial_number",
                "model",
                "failure_date",
                LABEL,
                "split",
                rule_score(F.col("smart_5_raw_num"), F.col("smart_197_raw_num")).alias(f"risk_{RULE}"),
                (load / (load + LOAD_HALF)).alias("risk_load_index"),
                (wear / (wear + WEAR_HALF)).alias("risk_wear_index"),
            )

        return self._stage("plain_predictions", build, "obs_date")

    def validation(self) -> DataFrame:
        return self.plain_predictions().where(F.col("split") == VALIDATION).drop("split")

    def test(self) -> DataFrame:
        return self.plain_predictions().where(F.col("split") == TEST).drop("split")

    def thresholds(self) -> dict[str, float]:
        """Thresholds of the plain scorers, chosen on validation."""
        return self._once(
            "thresholds",
            lambda: thresholds_at_fpr(self.validation(), {m: f"risk_{m}" for m in PLAIN_SCORERS}),
        )

    def metrics(self) -> DataFrame:
        """Tidy metrics of the plain scorers on both holdouts."""

        def build() -> DataFrame:
            chosen = self.thresholds()
            return stack_tables(
                evaluate_scores(self.validation(), chosen, VALIDATION), evaluate_scores(self.test(), chosen, TEST)
            )

        return self._stage("metrics", build)

    def prep(self) -> PipelineModel:
        return self._once("prep", lambda: fit_prep(self._training_rows()))

    def _training_rows(self) -> DataFrame:
        return sample_training(self.splits()[TRAIN], self.healthy_fraction)

    def prepared(self, split: str) -> DataFrame:
        return prepare(self.splits()[split], self.prep())

    def training(self) -> DataFrame:
        """Prepared training rows with weights: all positives, healthy rows of a share of the entities."""
        rows = self._training_rows()
        check_classes(rows, "training")
        return self._stage("training", lambda: prepare(rows, self.prep()))

    def scorers(self) -> dict:
        """Logistic regression and boosted trees."""

        def build() -> dict:
            held_out = self._stage("prepared_validation", lambda: self.prepared(VALIDATION))
            check_classes(held_out, "validation")
            return {
                "logistic_regression": fit_logistic(self.training()),
                "boosted_trees": fit_boosted(
                    self.training(), held_out, rounds=self.rounds, least_hessian=self.least_hessian
                ),
            }

        return self._once("scorers", build)

    def forest(self) -> Forest:
        healthy = prepare(sample_healthy(self.splits()[TRAIN], self.forest_fraction), self.prep())
        return self._once("forest", lambda: fit_isolation_forest(healthy))

    def scored(self, split: str) -> DataFrame:
        """All rows of a split scored by every fitted scorer and the rule."""

        def build() -> DataFrame:
            rows = score_isolation(self.prepared(split), self.forest(), ANOMALY)
            return score_holdout(rows, self.scorers(), keep=(ANOMALY,))

        return self._stage(f"scored_{split}", build, "obs_date")

    def predictions(self) -> DataFrame:
        """The scored test rows."""
        return self.scored(TEST)

    def histories(self) -> DataFrame:
        """Plain test scores in the order of device and day, for reads of one device."""
        key = self._key("histories")
        if key not in _written:
            path = new_path(self.spark, "histories")
            write_histories(self.test(), path, "serial_number", "obs_date")
            _written[key] = path
        return open_table(self.spark, _written[key])

    def learned_thresholds(self) -> dict[str, float]:
        """Thresholds of all scorers, chosen on validation."""
        return self._once("learned_thresholds", lambda: holdout_thresholds(self.scored(VALIDATION)))

    def learned_metrics(self) -> DataFrame:
        """Tidy metrics of all scorers on both holdouts, thresholds chosen on validation."""
        return self._stage(
            "learned_metrics",
            lambda: holdout_metrics({s: self.scored(s) for s in (VALIDATION, TEST)}, self.learned_thresholds()),
        )

    def save_run(self, root: str, name: str) -> runs.Run:
        """Store tables, scores, metrics, thresholds and fitted models of this study as one run."""
        numeric, _ = feature_columns(self.features().columns)
        models = {n: (self.prep(), m, numeric) for n, m in {**self.scorers(), FOREST: self.forest()}.items()}
        tables = {
            runs.RAW: self.stored_raw(),
            runs.LABELED: self.labeled(),
            runs.FEATURES: self.features(),
            runs.PREDICTIONS: self.predictions(),
        }
        parameters = {
            "horizon_days": self.horizon_days,
            "split": vars(self.split),
            "rounds": self.rounds,
            "healthy_fraction": self.healthy_fraction,
            "forest_fraction": self.forest_fraction,
            "least_hessian": self.least_hessian,
        }
        return runs.save_run(
            self.spark, root, name, tables, self.learned_metrics(), self.learned_thresholds(), models, parameters
        )


def _as_risks(scored: DataFrame) -> DataFrame:
    return scored.withColumnRenamed(ANOMALY, f"risk_{FOREST}")


def scorer_names(scored: DataFrame) -> list[str]:
    return [c.removeprefix("risk_") for c in _as_risks(scored).columns if c.startswith("risk_")]


def holdout_thresholds(validation: DataFrame, max_fpr: float = 0.01) -> dict[str, float]:
    """Thresholds of every score of a scored validation table."""
    return thresholds_at_fpr(_as_risks(validation), {m: f"risk_{m}" for m in scorer_names(validation)}, max_fpr)


def holdout_metrics(scored: dict[str, DataFrame], thresholds: dict[str, float]) -> DataFrame:
    """Tidy metrics of scored splits."""
    return stack_tables(*[evaluate_scores(_as_risks(df), thresholds, s) for s, df in scored.items()])


def score_with_run(run: runs.Run, rows: DataFrame) -> DataFrame:
    """Feature rows scored by the saved models of a run; other feature columns than the fitted ones are refused."""
    forest = run.model(FOREST)
    bundles = {n: run.model(n) for n in run.models if n != FOREST}
    scored = forest.score(rows, ANOMALY)
    for b in bundles.values():
        require_features(rows, b.numeric)
    return score_holdout(scored, {n: b.scorer for n, b in bundles.items()}, keep=(ANOMALY,))


def evaluate_saved(run: runs.Run, features: DataFrame, split: SplitSpec) -> tuple[DataFrame, DataFrame]:
    """(scored test rows, metrics) of the saved models of a run on a feature table, nothing fitted again.

    Thresholds are chosen anew on the validation rows. Both results are stored, so scoring runs once.
    """
    frames = split_frames(features, split)
    for s in (VALIDATION, TEST):
        check_classes(frames[s], s, both=s == VALIDATION)
    scored = {s: cut(score_with_run(run, frames[s]), f"saved_{s}") for s in (VALIDATION, TEST)}
    return scored[TEST], holdout_metrics(scored, holdout_thresholds(scored[VALIDATION]))


def score_sample(run: runs.Run, features: DataFrame, split: SplitSpec, modulus: int = 100) -> DataFrame:
    """The drill-down sample of the test period (all positives, the rows of 1 in n devices) with every saved score."""
    return score_with_run(run, drilldown_sample(features, split, modulus))
