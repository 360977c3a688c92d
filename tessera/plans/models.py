"""Models on spark.ml, walk-forward validation and final training."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Section, Settings, settings
from tessera.operators import filters as fl
from tessera.operators import metrics as mt
from tessera.operators.features import BINARY, CONTINUOUS
from tessera.plans import rank_trees
from tessera.session import side_by_side
from tessera.staging import scratch, staged, staging_path

KEYS = ["date", "ticker", "horizon"]
TARGETS = ["target_rank", "target_class", "forward_return", "forward_excess_return", "daily_median_forward_return"]
FIT = ["horizon", "split", "model_name"]


def feature_columns(frame: DataFrame) -> list[str]:
    """The catalogue's features and the sector one-hots, in that order: an allow-list, so no key or label slips in."""
    hot = sorted(c for c in frame.columns if c.startswith("sector_") and not c.startswith(("sector_mean_", "sector_rel_", "sector_vol_")))
    return [c for c in CONTINUOUS + BINARY if c in frame.columns] + hot


def _numeric(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("double") for c in columns})


def _assembled(columns: list[str], out: str) -> list:
    """Medians for gaps, then one vector."""
    return [Imputer(strategy="median", inputCols=columns, outputCols=[f"_{c}" for c in columns]), VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol=out, handleInvalid="keep")]


def baseline(frame: DataFrame, columns: list[str], cfg: Section | None = None) -> PipelineModel:
    """Medians for gaps, standard scores, and ridge logistic regression with balanced class weights."""
    cfg = cfg or settings().model.baseline
    frame = _numeric(frame, columns).withColumn("label", F.col("target_class").cast("double"))
    n, positive = frame.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(positive or 0, 1))).otherwise(n / (2 * max(n - (positive or 0), 1)))
    fit = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_weight", regParam=1 / (cfg.C * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=cfg.max_iter)
    return Pipeline(stages=[*_assembled(columns, "_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), fit]).fit(frame.withColumn("_weight", weight))


def ranker(frame: DataFrame, columns: list[str], cfg: Section | None = None, trees: int | None = None, validation: DataFrame | None = None) -> PipelineModel | rank_trees.RankTrees:
    """Boosted trees that rank each date's rows (backends lambdarank, listwise), or learn the rank (gbt) or the class (gbt_class) row by row."""
    cfg = cfg or settings().model.ranker
    if cfg.backend == "lambdarank":
        return rank_trees.fit(
            frame, columns, trees or cfg.n_estimators, rate=cfg.learning_rate, leaves=cfg.num_leaves, depth=cfg.max_depth, least_rows=cfg.min_child_samples, feature_fraction=cfg.feature_fraction,
            row_fraction=cfg.bagging_fraction, row_every=cfg.bagging_freq, validation=validation, patience=cfg.early_stopping_rounds,
        )
    if cfg.backend == "listwise":
        return listwise(frame, columns, cfg, trees or cfg.n_estimators)
    frame = _numeric(frame, columns).withColumn("label", F.col("target_class" if cfg.backend == "gbt_class" else "target_rank").cast("double"))
    shared = {
        "featuresCol": "_x", "labelCol": "label", "maxIter": trees or cfg.n_estimators, "stepSize": cfg.learning_rate, "maxDepth": cfg.max_depth, "subsamplingRate": cfg.bagging_fraction,
        "featureSubsetStrategy": str(cfg.feature_fraction), "minInstancesPerNode": cfg.min_child_samples, "seed": 7,
    }
    return Pipeline(stages=[*_assembled(columns, "_x"), GBTClassifier(**shared) if cfg.backend == "gbt_class" else GBTRegressor(**shared)]).fit(frame)


def listwise_gradient(score: str = "_score", rank: str = "target_rank", by: str = "date"):
    """What each row of a date should move by: its share of the date's gains less its share of the softmax of scores, times the date's rows.

    That is the gradient of the cross entropy between the two shares. It needs sums over a date's rows, no pairs of them.
    """
    w = Window.partitionBy(by)
    gain = F.pow(F.lit(2.0), F.coalesce(rank, F.lit(0.0))) - 1
    weight = F.exp(F.col(score) - F.max(score).over(w))
    wanted = F.coalesce(gain / F.when(F.sum(gain).over(w) > 0, F.sum(gain).over(w)), 1 / F.count("*").over(w))
    return (wanted - weight / F.sum(weight).over(w)) * F.count("*").over(w)


def listwise(frame: DataFrame, columns: list[str], cfg: Section, trees: int, cut: int = 20) -> PipelineModel:
    """Gradient-boosted trees with a list-wise loss over the rows of each date: each tree is fitted to listwise_gradient.

    The trees become one boosted model of spark.ml, saved and loaded like any other. Every `cut` trees the scores are written, which cuts the lineage.
    """
    ready = Pipeline(stages=_assembled(columns, "_x")).fit(_numeric(frame, columns))
    rows = staged(ready.transform(_numeric(frame, columns)).select("date", "target_rank", "_x", F.lit(0.0).alias("_score")))
    grown = []
    for k in range(trees):
        tree = RandomForestRegressor(
            featuresCol="_x", labelCol="_g", predictionCol="_p", numTrees=1, maxDepth=cfg.max_depth, minInstancesPerNode=cfg.min_child_samples,
            subsamplingRate=cfg.bagging_fraction, featureSubsetStrategy=str(cfg.feature_fraction), seed=7 + k,
        ).fit(rows.withColumn("_g", listwise_gradient()))
        grown.append(tree.trees[0])
        rows = tree.transform(rows).withColumn("_score", F.col("_score") + cfg.learning_rate * F.col("_p")).select("date", "target_rank", "_x", "_score")
        if k % cut == cut - 1:
            rows = staged(rows)
    context = frame.sparkSession.sparkContext
    own = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(grown))
    weights = context._gateway.new_array(context._jvm.double, len(grown))
    for k, tree in enumerate(grown):
        own[k], weights[k] = tree._java_obj, cfg.learning_rate
    boosted = GBTRegressionModel._from_java(context._jvm.org.apache.spark.ml.regression.GBTRegressionModel("listwise", own, weights, len(columns)))
    boosted.setFeaturesCol("_x")
    return PipelineModel([*ready.stages, boosted])


def score(model: PipelineModel, frame: DataFrame, columns: list[str]) -> DataFrame:
    """frame with score: the probability of class 1, or the predicted rank."""
    out = model.transform(_numeric(frame, columns))
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn("score", value).select(*frame.columns, "score")


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Features by importance, largest first: coefficients by size, trees' gains."""
    if isinstance(model, rank_trees.RankTrees):
        values = model.importances()
    else:
        last = model.stages[-1]
        values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(zip(columns, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))


def with_noise(frame: DataFrame, count: int = 3, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """frame with columns of standard normal noise: no feature should matter less than they do.

    A row's noise follows from its date, ticker and seed, so it is the same however often and wherever it is made.
    """
    names = [f"noise_{k}" for k in range(count)]
    uniform = lambda *salt: (F.pmod(F.xxhash64("date", "ticker", *map(F.lit, salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(seed, k, 0))) * F.cos(2 * F.pi() * uniform(seed, k, 1))
    return frame.withColumns({n: normal(k) for k, n in enumerate(names)}), names


def default_fitters(cfg: Settings) -> dict[str, Callable]:
    return {"baseline": lambda f, c: baseline(f, c, cfg.model.baseline), "ranker": lambda f, c: ranker(f, c, cfg.model.ranker)}


def walk_forward(frame: DataFrame, cfg: Settings, fitters: dict[str, Callable] | None = None, horizons: list[str] | None = None) -> dict[str, DataFrame]:
    """Fit and score every model on every split and horizon.

    Gives predictions, metrics (ranking, class balance, rows and train_rows of each fit), their summary,
    drift (noise columns too), calibration and importance. Splits that leave less than the embargo raise; parts without rows are skipped. The frame
    is written once, each split's rows once, and each fit's predictions once, to a folder of its own; all measures are taken from those.
    Up to validation.fits_at_once splits are fitted side by side.
    """
    fitters = fitters or default_fitters(cfg)
    spark, columns, written = frame.sparkSession, feature_columns(frame), staging_path(frame.sparkSession)
    extra = [c for c in ("earnings_in_window",) if c in frame.columns]
    for split in cfg.validation.splits:
        fl.check_embargo(split.train_end, split.val_start, cfg.validation.embargo_days)

    def fitted(rows: DataFrame, horizon: str, name: str, split: Section) -> dict | None:
        """Write one split's drift and predictions of all models; what each model was fitted on and its importances."""
        with scratch(spark):
            parts = fl.purged_split(fl.eligible(rows, horizon), split.train_end, split.val_start, split.val_end)
            (train, noise), (val, _) = (with_noise(p, cfg.features.random_noise_feature_count, 7 + n) for n, p in enumerate(parts))
            both = staged(train.withColumn("_part", F.lit(0)).unionByName(val.withColumn("_part", F.lit(1))))
            train, val = (both.where(F.col("_part") == n).drop("_part") for n in (0, 1))
            sizes = dict(both.groupBy("_part").agg(F.count("*")).collect())
            if len(sizes) < 2:
                return None
            out, used = {"at": f"{horizon}-{name}", "fits": [], "ranks": []}, columns + noise
            named = {"horizon": F.lit(horizon), "split": F.lit(name)}
            mt.feature_drift(train, val, used).withColumns(named).write.mode("overwrite").parquet(f"{written}/drift/{out['at']}")
            for model_name, fit in fitters.items():
                model = fit(train, used)
                scored = score(model, val, used).select(*KEYS, *TARGETS, *extra, "score").withColumns({"model_name": F.lit(model_name), "split": F.lit(name)})
                scored.write.mode("overwrite").parquet(f"{written}/predictions/{out['at']}-{model_name}")
                found = importances(model, used)
                out["fits"].append((horizon, name, model_name, sizes[0], float(sum(abs(v) for n, v in found if n in noise))))
                out["ranks"] += [(horizon, name, model_name, n, v, r) for r, (n, v) in enumerate(found, 1)]
            return out

    with scratch(spark):
        rows = staged(frame.select(*KEYS, *TARGETS, *extra, "trainable", "label_truncated", "label_end_date", *columns))
        jobs = [partial(fitted, rows, h, f"split_{k}", s) for h in horizons or list(cfg.horizons) for k, s in enumerate(cfg.validation.splits, 1)]
        done = [out for out in side_by_side(spark, jobs, cfg.validation.fits_at_once) if out]
    if not done:
        raise ValueError("no split has rows for training and validation")
    fits, ranks = ([row for out in done for row in out[key]] for key in ("fits", "ranks"))
    predictions = spark.read.parquet(*(f"{written}/predictions/{h}-{s}-{m}" for h, s, m, *_ in fits))
    facts = spark.createDataFrame(fits, "horizon string, split string, model_name string, train_rows long, noise_importance double")  # a row a fit
    balance = mt.class_imbalance(predictions, tuple(FIT))
    metrics = staged(mt.ranking_metrics(predictions, cfg.recommendation.buy_fraction, tuple(FIT)).join(balance, FIT).join(facts, FIT))
    importance = spark.createDataFrame(ranks, "horizon string, split string, model_name string, feature string, importance double, place int")
    return {
        "predictions": predictions, "metrics": metrics, "summary": mt.validation_summary(metrics), "drift": spark.read.parquet(*(f"{written}/drift/{out['at']}" for out in done)),
        "calibration": mt.calibration(predictions, by=tuple(FIT)), "importance": importance,
    }


def training_rows(frame: DataFrame, cfg: Settings, horizon: str) -> DataFrame:
    """What a final model of a horizon learns from: eligible rows before the holdout, those cut off by the end of data too."""
    return fl.eligible(frame, horizon, validation=False).where(F.col("date") < F.lit(cfg.validation.holdout_start).cast("date"))


def train_final(frame: DataFrame, cfg: Settings, fitters: dict[str, Callable] | None = None, horizons: list[str] | None = None) -> dict[tuple[str, str], tuple[PipelineModel, dict]]:
    """Models of each horizon on all rows before the holdout, with what each was trained on; horizons side by side."""
    fitters, spark, columns = fitters or default_fitters(cfg), frame.sparkSession, feature_columns(frame)

    def fitted(horizon: str) -> dict:
        with scratch(spark):
            rows = staged(training_rows(frame, cfg, horizon).select(*KEYS, *TARGETS, *columns))
            n, first, last = rows.agg(F.count("*"), F.min("date"), F.max("date")).first()
            about = {"horizon": horizon, "feature_columns": columns, "trained_rows": n, "train_start": str(first), "train_end": str(last)}
            return {(horizon, name): (fit(rows, columns), about | {"model_name": name}) for name, fit in fitters.items()} if n else {}

    found = side_by_side(spark, [partial(fitted, h) for h in horizons or list(cfg.horizons)], cfg.validation.fits_at_once)
    return {key: value for each in found for key, value in each.items()}


def save_models(models: dict[tuple[str, str], tuple[PipelineModel, dict]], path: str) -> None:
    """Each model in its own folder by spark.ml's writer, and a registry of what there is, one JSON line each."""
    for (horizon, name), (model, _) in models.items():
        save_model(model, f"{path}/{horizon}_{name}")
    if models and (spark := SparkSession.getActiveSession()):
        spark.createDataFrame([(json.dumps(about),) for _, about in models.values()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/registry")


def save_model(model: PipelineModel | rank_trees.RankTrees, path: str) -> None:
    if isinstance(model, rank_trees.RankTrees):
        model.save(SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | rank_trees.RankTrees:
    spark = SparkSession.getActiveSession()
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rank_trees")
    return rank_trees.RankTrees.load(spark, path) if own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own) else PipelineModel.load(path)


def last_model_scores(predictions: DataFrame) -> DataFrame:
    """One score for each key: the last split's, where splits overlap."""
    w = Window.partitionBy(*KEYS, "model_name").orderBy(F.col("split").desc())
    return predictions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
