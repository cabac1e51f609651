"""Model training, scoring, calibration and benchmarking with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .evidence import Item, Provider
from .leakage import check_split_leakage
from .scoring import class_metrics, rank_models, ranking_metrics
from .skew import hash_order


def usable_rows(df: DataFrame) -> DataFrame:
    """Rows with available features and no NULL in any feature or the label."""
    out = df.filter(F.col("features_available")) if "features_available" in df.columns else df
    return out.dropna(subset=[*C.FEATURE_COLUMNS, "label"])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add balanced weights n / (2 * n_class); two rows are broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    weights = counts.select(label, (total / (2.0 * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def _assembler(out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=C.FEATURE_COLUMNS, outputCol=out, handleInvalid="keep")


def _model(name: str, seed: int, trees: int | None) -> Pipeline:
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    if name == "logistic_regression":
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        return Pipeline(stages=[_assembler("raw_features"), scaler, LogisticRegression(maxIter=2000, **common)])
    if name == "forest":
        stage = RandomForestClassifier(numTrees=trees or 300, maxDepth=12, seed=seed, **common)
    elif name == "forest_deep":
        stage = RandomForestClassifier(numTrees=trees or 500, maxDepth=30, minInstancesPerNode=2, seed=seed, **common)
    elif name == "boosting":
        stage = GBTClassifier(maxIter=trees or 300, maxDepth=6, stepSize=0.1, subsamplingRate=0.9, seed=seed, **common)
    else:
        raise ValueError(f"unknown model: {name}")
    return Pipeline(stages=[_assembler("features"), stage])


CANDIDATES = ["forest", "forest_deep", "boosting", "logistic_regression"]


def fit(df: DataFrame, name: str = "forest", *, seed: int = 42, trees: int | None = None) -> PipelineModel:
    """Train one candidate with balanced class weights."""
    weighted = class_weights(df.withColumn("label", F.col("label").cast("double")))
    return _model(name, seed, trees).fit(weighted)


def score(model: PipelineModel, df: DataFrame, *, threshold: float = C.HIGH_RISK, version: str = "forest") -> DataFrame:
    """Batch scoring: risk score, confidence, prediction and model version."""
    risk = vector_to_array("probability")[1]
    scored = model.transform(df).withColumn("_p", risk)
    return scored.select(
        *df.columns, F.col("_p").alias("risk_probability"), F.round("_p", 4).alias("risk_score"),
        F.round(F.greatest("_p", 1 - F.col("_p")), 4).alias("confidence"),
        F.when(F.col("_p") >= threshold, "suspicious").otherwise("genuine").alias("prediction"),
        F.lit(version).alias("model_version"),
    )


def importances(model: PipelineModel, spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(C.FEATURE_COLUMNS, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def evaluate(scored: DataFrame, model: str, label: str = "label") -> DataFrame:
    """One metric row of a scored table, with ranking metrics."""
    rows = scored.withColumn("_predicted", (F.col("prediction") == "suspicious").cast("int"))
    block = class_metrics(rows, label, "_predicted").drop("group_value")
    ranking = ranking_metrics(rows, "risk_probability" if "risk_probability" in rows.columns else "risk_score", label)
    return block.withColumns(
        {"roc_auc": ranking.select("roc_auc").scalar(), "pr_auc": ranking.select("pr_auc").scalar(), "model": F.lit(model)}
    )


def benchmark(
    df: DataFrame, candidates: list[str] = CANDIDATES, *, seed: int = 42, trees: int | None = None
) -> DataFrame:
    """Train every candidate on the stored split and rank them; nothing is promoted.

    The leakage gate runs first. Features are cached once for all candidates.
    """
    check_split_leakage(df)
    rows = usable_rows(df).select(*C.FEATURE_COLUMNS, "label", "split", "certificate_type").cache()
    try:
        sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        if min(sizes.get("train", 0), sizes.get("test", 0)) < 10:
            raise ValueError("at least ten train and ten test rows are needed")
        train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        results = [
            evaluate(score(fit(train, name, seed=seed, trees=trees), test, version=name), name) for name in candidates
        ]
        ranked = rank_models(reduce(lambda a, b: a.unionByName(b), results))
        # One row per candidate: bring the finished metrics home before the cache goes.
        return df.sparkSession.createDataFrame(ranked.collect(), ranked.schema).withColumn("promoted", F.lit(False))
    finally:
        rows.unpersist()


def out_of_fold(df: DataFrame, row_id: str, name: str, *, folds: int = 3, seed: int = 42, trees: int | None = None) -> DataFrame:
    """Scores for every row from models that did not see it; folds by seeded hash."""
    keyed = df.withColumn("_fold", F.pmod(hash_order(F.col(row_id), seed=seed), F.lit(folds)))
    parts = []
    for k in range(folds):
        model = fit(keyed.filter(F.col("_fold") != k).drop("_fold"), name, seed=seed, trees=trees)
        parts.append(score(model, keyed.filter(F.col("_fold") == k), version=name))
    return reduce(lambda a, b: a.unionByName(b), parts).drop("_fold")


def calibrate(scored: DataFrame, method: str = "sigmoid") -> Callable[[DataFrame], DataFrame]:
    """Fit a calibration map on out-of-fold scores; returns a DataFrame transform."""
    rows = scored.select(F.col("risk_score").alias("s"), F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=["s"], outputCol="v")
    if method == "sigmoid":
        model = LogisticRegression(featuresCol="v", labelCol="label").fit(assembler.transform(rows))
        probability: Column = vector_to_array("probability")[1]
    elif method == "isotonic":
        model = IsotonicRegression(featuresCol="v", labelCol="label").fit(assembler.transform(rows))
        probability = F.col("prediction")
    else:
        raise ValueError("method must be 'sigmoid' or 'isotonic'")

    def apply(df: DataFrame) -> DataFrame:
        renamed = df.withColumnRenamed("prediction", "_class") if "prediction" in df.columns else df
        out = model.transform(assembler.transform(renamed.withColumn("s", F.col("risk_score"))))
        out = out.withColumn("calibrated", F.round(probability, 4))
        kept = out.select(*renamed.columns, "calibrated")
        return kept.withColumnRenamed("_class", "prediction") if "_class" in kept.columns else kept

    return apply


class ScorerRegistry:
    """Named scorers that add risk columns; the fusion treats each as one evidence source.

    `apply` runs every scorer over the documents and keeps each verdict in a struct column of its
    own; `providers` declares one evidence item per verdict for `with_masses`, `with_evidence_items`
    and `verify_documents`. A missing verdict gives no item.
    """

    def __init__(self) -> None:
        self._scorers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
        self._scorers[name] = scorer

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        return self._scorers[name]

    def names(self) -> list[str]:
        return sorted(self._scorers)

    @staticmethod
    def verdict_column(name: str) -> str:
        return f"verdict_{name}"

    def apply(self, df: DataFrame) -> DataFrame:
        """Add verdict_<name> (prediction, risk_score, confidence) of every scorer; no join."""
        verdict = ("prediction", "risk_score", "confidence")
        for name in self.names():
            held = [c for c in verdict if c in df.columns]  # the documents' own verdict steps aside
            own = df.withColumnsRenamed({c: f"_own_{c}" for c in held})
            scored = self.get(name)(own).withColumn(self.verdict_column(name), F.struct(*verdict)).drop(*verdict)
            df = scored.select(*own.columns, self.verdict_column(name)).withColumnsRenamed({f"_own_{c}": c for c in held})
        return df

    def provider(self, name: str) -> Provider:
        """Evidence of one scorer, judged by the bands of the main model."""

        def items(df: DataFrame) -> list[Item]:
            v = F.col(self.verdict_column(name))
            risk = v["risk_score"]
            high = (v["prediction"] == "suspicious") | (risk >= C.HIGH_RISK)
            raised = risk >= C.ELEVATED_RISK
            return [
                Item(name, "ML", "risk_score", risk.isNotNull(), F.when(high | raised, "WARNING").otherwise("PASS"),
                     F.when(high, "high").when(raised, "medium").otherwise("low"), F.coalesce(v["confidence"], F.lit(0.5)),
                     F.concat(F.lit("Risk score "), F.format_string("%.3f", risk)))
            ]

        return items

    def providers(self) -> list[Provider]:
        return [self.provider(name) for name in self.names()]

    def evidence(self, name: str, df: DataFrame, key: str = "document_id") -> DataFrame:
        """The scorer's verdict as one evidence row per document."""
        scored = self.get(name)(df)
        return scored.select(
            key, F.lit(name).alias("provider"), "prediction", "risk_score", "confidence",
            F.lit(len(C.FEATURE_COLUMNS)).alias("feature_count"),
        )
