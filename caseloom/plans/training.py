"""A whole training run: checks, features, cross-validation, evaluation, recommendation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.columns import col, normalise_names, number, split_text_derived
from caseloom.operators.cleaning import clean_table
from caseloom.operators.encoding import class_balance, encode_target, label_list, with_class_weights
from caseloom.operators.metrics import (
    CLASSIFICATION_METRICS, REGRESSION_METRICS, classification_metrics, parent_importance, recommend, recommend_by_cv, regression_metrics,
)
from caseloom.operators.profile import feature_defaults, scoring_schema
from caseloom.operators.splits import assign_folds, check_test_size, local_if_small, train_test
from caseloom.operators.tfidf import Vocabulary
from caseloom.operators.tickets import (
    TARGETS, TicketRecipe, add_resolution_hours, apply_recipe, as_numbers, fit_recipe, parse_dates,
)
from caseloom.operators.transforms import choose_scaler, needs_log, outlier_counts
from caseloom.operators.validate import detect_problem_type, validate_inputs
from caseloom.plans.features import FeatureRecipe, fit_features
from caseloom.plans.models import CV_FOLDS, FIT, cross_validate, default_models, fit_pipeline
from caseloom.session import cut_lineage

ROW, FOLD, FOLD_SEED = "__row", "__fold", 43
#: Another seed than the split's and the folds': with one of theirs all rows to fit would lie in one fold.
FIT_SEED = 44
#: Rows of each class and fold that a bound on the fitted rows keeps, as far as there are so many.
FIT_LEAST = 20
#: Training rows of a task at least, where there are so many.
TASK_ROWS = 50_000


@dataclass
class TrainedRun:
    """Models with everything needed to report on them and to score new rows."""

    problem_type: str
    target: str
    was_log_transformed: bool
    labels: list[str]
    scaler: str
    recipe: FeatureRecipe
    ticket_recipe: TicketRecipe | None
    defaults: dict[str, float | str | None]
    models: dict[str, PipelineModel]
    recommended: str
    results: DataFrame
    cv_results: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def recommended_model(self) -> PipelineModel:
        return self.models[self.recommended]

    def model_list(self) -> DataFrame:
        """Every trained model with its results, the recommended one marked."""
        return self.results.withColumn("recommended", F.col("model") == self.recommended)

    def importance(self, spark: SparkSession, model: str | None = None) -> DataFrame:
        return feature_importance(spark, self.models[model or self.recommended], self.recipe.features)

    def top_features(self, spark: SparkSession, model: str | None = None) -> DataFrame:
        plain, derived = split_text_derived(list(self.defaults))
        return parent_importance(self.importance(spark, model), plain, derived)


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """`feature, importance`, highest first: tree importances or absolute coefficients (mean over
    classes).  Empty for a kernel machine, whose inputs are not the named features."""
    last = model.stages[-1]
    if isinstance(last, PipelineModel):  # trees behind the bins of the same features
        last = last.stages[-1]
    values: list[float] = []
    if len(model.stages) == 2:
        parts = last.models if isinstance(last, OneVsRestModel) else [last]
        for part in parts:
            if hasattr(part, "featureImportances"):
                found = part.featureImportances.toArray()
            elif getattr(part, "numClasses", 2) > 2:
                found = abs(part.coefficientMatrix.toArray()).mean(axis=0)
            else:
                found = abs(part.coefficients.toArray())
            values = [a + b / len(parts) for a, b in zip(values or [0.0] * len(found), found)]
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _checked(df: DataFrame, target: str) -> DataFrame:
    findings = validate_inputs(df, target)
    errors = [r for r in findings.collect() if r["level"] == "error"]
    if errors:
        raise ValueError("; ".join(f"{r['code']} ({r['detail']})" for r in errors))
    return findings


def _predictions(model: PipelineModel, test: DataFrame, was_log: bool) -> DataFrame:
    scored = model.transform(test).select("label", "prediction")
    return scored.select(F.expm1("label").alias("label"), F.expm1("prediction").alias("prediction")) if was_log else scored


def mark_fit_rows(rows: DataFrame, fit_rows: int, key: str, strata: list[str]) -> DataFrame:
    """Adds FIT: true for `fit_rows` rows, the first by a hash of the row's key, so that rows with equal features are told apart.

    Strata have their share, small ones about FIT_LEAST rows.  Few strata are broadcast, as a shuffle by them would put
    all rows in as many tasks.
    """
    counts = local_if_small(rows.groupBy(*strata).agg(F.count("*").alias("__n")))
    least = FIT_LEAST * rows.count() / fit_rows
    share = F.shiftrightunsigned(F.xxhash64(F.lit(FIT_SEED), key), 11) / F.lit(2.0**53)
    placed = rows.join(counts, strata).withColumn("__at", share / F.greatest(F.lit(1.0), F.lit(least) / F.col("__n")))
    last = placed.select("__at").orderBy("__at").limit(fit_rows).agg(F.max("__at")).first()[0]
    return placed.withColumn(FIT, F.col("__at") <= F.lit(last)).drop("__n", "__at")


def fit_models(
    training: DataFrame, models: dict[str, list], scaler: str, problem_type: str, folds: int = CV_FOLDS
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """(fits on all training rows, `model, cv_..._mean, cv_..._std`); `folds` 0 skips cross-validation."""
    fitted, scores = {}, []
    for name, stages in models.items():
        if folds:
            checked = cross_validate(training, stages, scaler, problem_type, folds, FOLD)
            fitted[name] = checked.bestModel
            scores.append((name, float(checked.avgMetrics[0]), float(checked.stdMetrics[0])))
        else:
            fitted[name] = fit_pipeline(training, stages, scaler)
    metric = "cv_f1_macro" if problem_type == "classification" else "cv_r2"
    schema = f"model string, {metric}_mean double, {metric}_std double"
    return fitted, training.sparkSession.createDataFrame(scores, schema)


def evaluate_models(
    models: dict[str, PipelineModel], test: DataFrame, problem_type: str, was_log: bool = False
) -> DataFrame:
    """Test metrics per model; a logged target is turned back first."""
    measure = classification_metrics if problem_type == "classification" else regression_metrics
    rows = [(name, *measure(_predictions(model, test, was_log)).first()) for name, model in models.items()]
    names = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    return test.sparkSession.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in names))


def train(
    df: DataFrame, target: str | None = None, task: str | None = None, priority: str | None = None,
    test_size: float = 0.2, folds: int = CV_FOLDS, effort: float = 1.0, only: list[str] | None = None,
    day_first: bool = False, fit_rows: int | None = None, selection: str = "bins",
) -> TrainedRun:
    """Train the default models for a target column or a ticket task and recommend one.

    The split comes first and everything learned (text vocabulary, medians, categories, feature
    choice, scaler, models) is learned from training rows only.  Cleaned rows are written to the
    checkpoint folder once, as the fits read them many times.  `priority` is the test metric to
    recommend by; without it the cross-validation mean decides.  `fit_rows` bounds the rows that classifiers are fitted
    on (see mark_fit_rows); regressors are fitted on all training rows, and checks, features, scalers, class weights, fold
    scores and the evaluation use all rows in any case.  `selection` is the estimate that chooses numeric features: over
    `bins`, or by nearest `neighbours`, which can prefer a square root or logarithm.
    """
    spark = df.sparkSession
    check_test_size(test_size)
    if task is not None and task not in TARGETS:
        raise ValueError(f"task must be one of {sorted(TARGETS)}, not {task!r}")
    if task:
        df = parse_dates(normalise_names(df), day_first)
        target = TARGETS[task]
        if task == "resolution":
            df = add_resolution_hours(df)
    if not target:
        raise ValueError("either target or task is needed")
    warnings = _checked(df, target)
    problem = detect_problem_type(df, target, task)
    is_class = problem == "classification"

    cleaned, clean_report = clean_table(df, target, impute=False, row_id=ROW)
    by_class = target if is_class else None
    train_rows, test_rows = train_test(cleaned, test_size, stratify=by_class, key=ROW)
    # Folds are drawn by the row's key, and so are the rows to fit: later many rows share the same features.
    train_rows = assign_folds(train_rows, max(2, folds), stratify=by_class, seed=FOLD_SEED, key=ROW, out=FOLD)
    test_rows = test_rows.drop(ROW)
    marks = [FOLD, ROW]

    ticket_recipe = None
    if task:
        ticket_recipe = fit_recipe(train_rows, task)
        train_rows, test_rows = (
            as_numbers(apply_recipe(part, ticket_recipe), target) for part in (train_rows, test_rows)
        )
        train_rows = cut_lineage(train_rows)  # so that texts are read once, not in every later pass
    was_log = needs_log(train_rows.drop(*marks), target, problem)
    labels: list[str] = []
    balance = None
    if is_class:
        balance, labels = class_balance(cleaned, target), label_list(cleaned, target)

    recipe = fit_features(train_rows.drop(*marks), target, is_class, selection=selection)
    if not recipe.features:
        raise ValueError("no informative feature is left; try another target")

    def inputs(part: DataFrame) -> DataFrame:
        if is_class:
            coded, _ = encode_target(part.withColumn("label", col(target)), "label", labels)
        else:
            coded = part.withColumn("label", F.log1p(number(target)) if was_log else number(target))
        keep = ["label", *[c for c in coded.columns if c in marks]]
        return recipe.apply(coded.where(F.col("label").isNotNull()), keep)

    training = inputs(train_rows)
    selected = train_rows.select(*recipe.expressions(recipe.selected, train_rows.columns))
    outliers = outlier_counts(selected, columns=list(recipe.selected))
    scaler = choose_scaler(outliers.count(), len(recipe.features))
    if is_class:
        training = with_class_weights(training, "label")
        if fit_rows is not None:
            training = mark_fit_rows(training, fit_rows, ROW, ["label", FOLD])
    # Fits pass over the rows hundreds of times: a table lies in so many files that tasks do not outweigh the rows, and
    # that no task has most of them, as the joins before may leave a small table in one partition.
    training = training.drop(ROW)
    training = cut_lineage(training.repartition(max(1, -(-training.count() // TASK_ROWS))))
    fitted = training.where(FIT) if FIT in training.columns else training
    test = inputs(test_rows).persist()

    chosen = {
        name: stages for name, stages in default_models(problem, fitted.count(), len(labels), effort).items()
        if not only or name in only
    }
    models, cv = fit_models(training, chosen, scaler, problem, folds)
    results = evaluate_models(models, test, problem, was_log)
    test.unpersist()
    best = recommend(results, problem, priority) if priority or not folds else recommend_by_cv(cv, problem)

    sources = [c for c in train_rows.columns if c not in (target, *marks)]
    return TrainedRun(
        problem_type=problem, target=target, was_log_transformed=was_log, labels=labels, scaler=scaler, recipe=recipe,
        ticket_recipe=ticket_recipe,
        defaults={r["name"]: r["number"] if r["text"] is None else r["text"]
                  for r in feature_defaults(train_rows, sources).collect()},
        models=models, recommended=best.first()["model"], results=results, cv_results=cv,
        reports={
            "warnings": warnings, "cleaning": clean_report, "outliers": outliers,
            "form": scoring_schema(train_rows, sources), **({"balance": balance} if balance is not None else {}),
        },
    )


def save_run(run: TrainedRun, path: str) -> None:
    """Write models as Spark ML folders and the rest as one-row JSON plus result tables."""
    spark = run.results.sparkSession
    names = list(run.models)
    for i, name in enumerate(names):
        run.models[name].write().overwrite().save(f"{path}/models/{i}")
    run.results.coalesce(1).write.mode("overwrite").parquet(f"{path}/results")
    run.cv_results.coalesce(1).write.mode("overwrite").parquet(f"{path}/cv_results")
    meta = {
        "problem_type": run.problem_type, "target": run.target, "was_log_transformed": run.was_log_transformed,
        "labels": run.labels, "scaler": run.scaler, "recipe": asdict(run.recipe), "defaults": run.defaults,
        "ticket_recipe": asdict(run.ticket_recipe) if run.ticket_recipe else None, "recommended": run.recommended,
        "models": names,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_run(spark: SparkSession, path: str) -> TrainedRun:
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    recipe = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["recipe"].items()}
    ticket = meta["ticket_recipe"]
    if ticket:
        vocabulary = Vocabulary(**{k: tuple(v) for k, v in ticket["vocabulary"].items()})
        ticket = TicketRecipe(ticket["task"], tuple(ticket["products"]), vocabulary, ticket["as_of"])
    return TrainedRun(
        problem_type=meta["problem_type"], target=meta["target"], was_log_transformed=meta["was_log_transformed"],
        labels=meta["labels"], scaler=meta["scaler"], recipe=FeatureRecipe(**recipe), ticket_recipe=ticket,
        defaults=meta["defaults"],
        models={n: PipelineModel.load(f"{path}/models/{i}") for i, n in enumerate(meta["models"])},
        recommended=meta["recommended"], results=spark.read.parquet(f"{path}/results"),
        cv_results=spark.read.parquet(f"{path}/cv_results"),
    )

