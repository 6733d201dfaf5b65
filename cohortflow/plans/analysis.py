"""From the wide feature table to trained, evaluated and explained models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.operators import dist, encode, explain, fairness, metrics, models
from cohortflow.operators.cohort import first_per_key
from cohortflow.operators.impute import KnnImputer, preprocess
from cohortflow.operators.outliers import continuous_columns
from cohortflow.operators.scores import first_match
from cohortflow.operators.split import stratified_split
from cohortflow.session import settle
from cohortflow.sources.io import union_all

# fixed values: column groups and codes of the wide table
NOT_MODELLED = (
    "dod", "icu_hours", "weight_kg", "height", "icdcode_reason", "apacheii_md", "apacheii_cr_h", "apacheii_cr_hp",
    "apacheiii", "max_rate_std", "zcrp_fdv", "fio2_apii", "fio2_apiv", "fio2_ecmoch", "fio2_ecmo", "albumin_bg",
    "albumin_urine_chem", "albumin_bl_chem_85", "albumin_bl_chem_38", "albumin_asc_chem", "albumin_jointf_chem",
    "lactate_442", "lactate_chem", "ph_fluid", "po2_042", "po2_bfluid", "pco2_040", "pco2_830", "crp_highsens",
    "crp_bl_chem", "mpv", "wbcc", "inr", "admission_type",
)
KEYS = ("subject_id", "stay_id")
RANK = "admission_rank"
LABELS = ("d48h", "d90d", "dinhosp")
DEMOGRAPHICS = ("gender", "race", "language", "insurance")
INTEGERS = ("age", "sirs_score", "sofa_score", "oasis")
CONTINUOUS = (
    "BMI", "gcs", "crp_fdv", "wbc_fdv", "heart_rate", "sbp", "dbp", "body_temp", "spo2", "resp_rate", "fio2",
    "albumin_bl_chem", "aniongap", "bun", "calcium_chem", "chloride_chem", "creatinine_chem", "glucose_chem",
    "sodium_chem", "potassium_chem", "magnesium_chem", "lactate_813", "bicarbonate", "ph", "po2_821", "pco2_818",
    "hematocrit", "hemoglobin", "platelet", "NeuC", "EoC", "LymC", "nl_ratio",
)
FORCED = {"gender": (0, 1), "race": (0, 1, 2, 3, 4), "language": (0, 1), "insurance": (0, 1, 2, 3)}
VALUE_NAMES = {
    "gender": {0: "Female", 1: "Male"},
    "race": {0: "Other", 1: "Hispanic", 2: "Black", 3: "Asian", 4: "White"},
    "language": {0: "Non-English", 1: "English"},
    "insurance": {0: "No pay/Other", 1: "Medicaid", 2: "Medicare", 3: "Private"},
}
TREATED = ("BMI", "body_temp", "wbc_fdv", "fio2")
GBT_FIRST = {
    "max_depth": 5, "min_child_weight": 7, "gamma": 0.75, "subsample": 0.8, "colsample_bytree": 0.6,
    "learning_rate": 0.05, "scale_pos_weight": 2, "n_estimators": 350,
}
GBT_SECOND = {
    "max_depth": 5, "learning_rate": 0.05, "n_estimators": 700, "min_data_in_leaf": 25, "max_bin": 127,
    "feature_fraction": 0.6, "bagging_fraction": 0.6, "min_gain_to_split": 0.2,
}
SPACE_FIRST = {
    "max_depth": [3, 5, 7, 9], "min_child_weight": [1, 3, 5, 7], "gamma": [0, 0.25, 0.5, 0.75, 1],
    "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0], "learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2],
    "scale_pos_weight": [1, 2, 4, 6, 8, 10], "n_estimators": [100, 150, 200, 250, 300, 350],
}
SPACE_SECOND = {
    "max_depth": [3, 5, 7, 10, 12], "learning_rate": [0.005, 0.01, 0.05, 0.1, 0.15],
    "n_estimators": [100, 200, 300, 500, 700], "min_data_in_leaf": [10, 25, 45, 80, 100], "max_bin": [63, 127, 255],
    "feature_fraction": [0.6, 0.8, 1.0], "bagging_fraction": [0.6, 0.8, 1.0], "min_gain_to_split": [0, 0.1, 0.2, 0.3],
}


def encodings() -> dict[str, Column]:
    """Numeric codes of the text columns."""
    insurance = F.upper("insurance")
    return {
        "diagnosis": encode.map_values(F.col("diagnosis"), {"Sepsis": 1, "SIRS": 0}),
        "gender": encode.map_values(F.col("gender"), {"M": 1, "F": 0}),
        "language": encode.map_values(F.col("language"), {"English": 1}, F.lit(0)),
        "race": encode.map_contains(
            F.col("race"),
            [(("HISPANIC", "LATINO"), 1), (("BLACK", "AFRICAN"), 2), (("ASIAN",), 3), (("WHITE",), 4)],
            F.lit(0),
        ),
        "insurance": encode.map_values(insurance, {"PRIVATE": 3, "MEDICARE": 2, "MEDICAID": 1}, F.lit(0)),
    }


def name_groups(df: DataFrame) -> DataFrame:
    """Add ``group_name``, the readable form of ``group_col`` and ``group_value``, where one is known."""
    rules = [
        ((F.col("group_col") == c) & (F.col("group_value").cast("double") == float(v)), F.lit(name))
        for c, names in VALUE_NAMES.items()
        for v, name in names.items()
    ]
    numeric = F.col("group_col").isin(*VALUE_NAMES) & F.col("group_value").rlike(r"^[0-9]+(\.0)?$")
    return df.withColumn("group_name", F.when(numeric, first_match(rules)))


def prepare(
    df: DataFrame,
    drop: Sequence[str],
    codes: dict[str, Column],
    column_sets: Sequence[Sequence[str]],
    threshold: float = 0.8,
    count_over: Sequence[str] | None = None,
) -> DataFrame:
    """Encode, drop, count nulls per row and keep the rows complete enough in every column set."""
    out = df.withColumns(codes).drop(*drop)
    out = encode.add_missing_count(out, columns=count_over or [c for c in out.columns])
    return encode.keep_complete(out, column_sets, threshold)


def feature_columns(df: DataFrame) -> list[str]:
    skip = {*KEYS, *LABELS, "missing_count", "race", "language", "insurance", "split"}
    return [c for c in df.columns if c not in skip]


def initialise(wide: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Analysis table: keys, features, demographics, labels and ``missing_count``.

    Rows need the given share of non-null values among the 48 model features, and among all 55
    encoded columns. Where ``wide`` ranks the admissions of a stay, the first one whose row has them is kept.
    """
    modelled = [c for c in wide.columns if c not in {*NOT_MODELLED, *KEYS, RANK}]
    features = [c for c in modelled if c not in {*LABELS, "race", "language", "insurance"}]
    out = prepare(
        wide, NOT_MODELLED, encodings(), [features, [*modelled, "missing_count"]], threshold, count_over=modelled
    )
    return first_per_key(out, ["stay_id"], [RANK]).drop(RANK) if RANK in out.columns else out


@dataclass
class Variant:
    """A trained model with the transform its inputs need."""

    model: object
    transform: str = "none"


@dataclass
class TargetRun:
    """Everything one label's run produced. ``scored`` holds the test rows of every model."""

    label: str
    key: str
    features: list[str]
    train: DataFrame
    test: DataFrame
    imputer: KnnImputer
    variants: dict[str, Variant]
    scored: DataFrame
    fits: dict
    moments: dict
    settings: dict[str, dict] = field(default_factory=dict)

    def score(self, name: str, df: DataFrame) -> DataFrame:
        """Score any rows with model ``name``: the run's imputer, then the model's own transform."""
        ready = self.imputer.transform(df)
        kind = self.variants[name].transform
        if kind == "normal":
            ready = _normal(self.train, ready, self.fits)[1]
        elif kind == "standard":
            ready = dist.standardise(ready, self.moments)
        return _with_groups(_scored(self.variants[name].model, ready, self.features, self.key, self.label, name), df, self.key)

    def metrics(self) -> DataFrame:
        return metrics.full_evaluation(self.scored, "label", "pred", "p", ["model", "target"])

    def roc(self) -> DataFrame:
        """Points of every model's ROC curve on the test rows."""
        return metrics.roc_points(self.scored, "label", "p", ["model", "target"])

    def report(self) -> DataFrame:
        """Classification report of every model on the test rows."""
        return metrics.class_report(self.scored, "label", "pred", ["model", "target"])

    def importance(self, name: str, top: int = 20) -> DataFrame:
        """Features by mean absolute contribution on the test rows."""
        kind, model = self.variants[name].transform, self.variants[name].model
        train, test = self.train, self.test
        if kind == "normal":
            train, test = _normal(train, test, self.fits)
        elif kind == "standard":
            train, test = (dist.standardise(df, self.moments) for df in (train, test))
        return explain.shap_importance(explain.model_shap(test, self.key, self.features, model, train), top)


def _normal(train: DataFrame, other: DataFrame, fits: dict) -> list[DataFrame]:
    """Normal scores of both tables; ranks, where no family fits, are taken among the training rows."""
    columns = [c for c in train.columns if c in other.columns]
    both = train.select(*columns, F.lit(True).alias("_train")).unionByName(other.select(*columns, F.lit(False).alias("_train")))
    scores = dist.normal_scores(both, fits, F.col("_train"))
    return [scores.where(c).drop("_train") for c in (F.col("_train"), ~F.col("_train"))]


def run_target(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str = "stay_id",
    fits: dict | None = None,
    treat: Sequence[str] | None = None,
    first: dict | None = None,
    second: dict | None = None,
    search: dict | None = None,
    k: int = 50,
    seed: int = 42,
) -> TargetRun:
    """Split, impute, train and score the five models of one label.

    ``fits`` are distribution fits for the normalised variant; without them they are fitted on the
    training rows. ``treat`` are the columns whose outliers are masked, by default those with more
    than two values. ``search`` holds arguments of :func:`models.search` per boosted model.
    """
    features = list(features)
    parts = settle(stratified_split(df, label, key, seed=seed))
    if not parts.groupBy(key).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"{key} must identify the rows")
    keep = [c for c in parts.columns if c != "split"]
    train, test = (parts.where(F.col("split") == s).select(*keep) for s in ("train", "test"))
    if treat is None:
        treat = continuous_columns(train, features)
    train, test, imputer = preprocess(train, test, features, treat, key, k)

    if fits is None:
        fits = dist.best_fits(train, continuous_columns(train, features))
    moments = dist.fit_standard(train, features)
    normal = _normal(train, test, fits)
    inputs = {
        "lr_encoded": (train, test, "none"),
        "lr_normalized": (*normal, "normal"),
        "lr_standardized": (dist.standardise(train, moments), dist.standardise(test, moments), "standard"),
    }
    variants, scored, settings = {}, [], {}
    for name, (fit_on, score_on, transform) in inputs.items():
        model = models.fit_logistic(fit_on, features, label)
        variants[name] = Variant(model, transform)
        scored.append(_scored(model, score_on, features, key, label, name))
    for name, params in (("gbt_first", first or GBT_FIRST), ("gbt_second", second or GBT_SECOND)):
        if search and name in search:
            model, settings[name], _ = models.search(train, features, label, key=key, seed=seed, **search[name])
        else:
            model, settings[name] = models.fit_gbt(train, features, label, params, seed), params
        variants[name] = Variant(model)
        scored.append(_scored(model, test, features, key, label, name))
    done = settle(_with_groups(union_all(scored), parts, key))
    return TargetRun(label, key, features, train, test, imputer, variants, done, fits, moments, settings)


def _scored(model, df: DataFrame, features, key: str, label: str, name: str) -> DataFrame:
    out = models.predict(model, df, features, keep=[key, label])
    return out.withColumnRenamed(label, "label").withColumns({"model": F.lit(name), "target": F.lit(label)})


def _with_groups(scored: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Demographic columns by key from the untouched rows, not from imputed ones."""
    groups = [c for c in DEMOGRAPHICS if c in source.columns]
    return scored.join(source.select(key, *groups), key) if groups else scored


def model_grid(df: DataFrame, labels: Sequence[str], features: Sequence[str], **options) -> tuple[DataFrame, dict[str, TargetRun]]:
    """Every model for every label: long metric table ``(model, target, metric, value)`` and the runs."""
    runs = {y: run_target(df, y, features, **options) for y in labels}
    return union_all([r.metrics() for r in runs.values()]), runs


def group_evaluation(run: TargetRun, group_columns: Sequence[str] = DEMOGRAPHICS) -> DataFrame:
    """Metrics of each model per demographic group, on the held-out rows."""
    return metrics.group_metrics(
        run.scored, "label", "pred", "p", group_columns, ["model", "target"]
    )


def group_report(run: TargetRun, group_columns: Sequence[str] = DEMOGRAPHICS) -> DataFrame:
    """Classification report of each model per demographic group, on the held-out rows."""
    return metrics.group_report(run.scored, "label", "pred", group_columns, ["model", "target"])


def forced_bias(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str = "stay_id",
    forced: dict[str, Sequence] = FORCED,
    params: dict | None = None,
    treat: Sequence[str] = TREATED,
    k: int = 50,
    bins: int = 30,
    density: bool = False,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Score shift per forced demographic value, and the model's metrics.

    The model is trained with the demographics among its features; the test rows are then scored
    once per forced value. ``density=True`` gives kernel densities instead of histograms.
    """
    columns = list(dict.fromkeys([*features, *forced]))
    parts = settle(stratified_split(df.select(key, label, *columns), label, key, seed=seed))
    keep = [key, label, *columns]
    train, test = (parts.where(F.col("split") == s).select(*keep) for s in ("train", "test"))
    train, test, _ = preprocess(train, test, columns, treat, key, k)
    model = models.fit_gbt(train, columns, label, params or GBT_FIRST, seed)

    def score(rows: DataFrame) -> DataFrame:
        return models.predict(model, rows, columns, keep=["forced_col", "forced_value"])

    base = _scored(model, test, columns, key, label, "gbt_first")
    table = metrics.full_evaluation(base, "label", "pred", "p", ["model", "target"])
    if density:
        return fairness.forced_score_density(test, forced, score), table
    return fairness.forced_score_histogram(test, forced, score, bins=bins), table


def group_scores(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str = "stay_id",
    group_columns: Sequence[str] = DEMOGRAPHICS,
    prepare_with=preprocess,
    params: dict | None = None,
    treat: Sequence[str] = TREATED,
    k: int = 50,
    bins: int = 30,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Score distribution by observed group for a model trained without the demographics.

    Returns the histogram table and the model's metrics.
    """
    features = [c for c in features if c not in group_columns]
    parts = settle(stratified_split(df, label, key, seed=seed))
    keep = list(dict.fromkeys([key, label, *features, *group_columns]))
    train, test = (parts.where(F.col("split") == s).select(*keep) for s in ("train", "test"))
    train, test, _ = prepare_with(train, test, features, treat, key, k)
    model = models.fit_gbt(train, features, label, params or {}, seed)
    scored = models.predict(model, test, features, keep=[label, *group_columns])
    table = metrics.full_evaluation(scored, label, "pred", "p")
    return fairness.group_score_histogram(scored, "p", group_columns, bins), table
