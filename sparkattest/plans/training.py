"""Raw records to a chosen model: features, split, candidates, evaluation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.features import build_features
from ..operators.models import evaluate, fit, score
from ..operators.scoring import class_metrics
from ..operators.splits import stratified_split


@dataclass
class Trained:
    """The winning model, its name, and validation and test metrics."""

    model: PipelineModel
    name: str
    validation: DataFrame
    test: DataFrame
    by_type: DataFrame


def train(
    raw: DataFrame, row_id: str, *, as_of: dt.date, candidates: tuple[str, ...] = ("logistic_regression", "forest"),
    seed: int = 42, trees: int | None = None, known_issuer: Column | None = None,
) -> Trained:
    """Train the candidates and keep the best validation F1.

    The feature table is cached once and shared by all fits.
    """
    features = build_features(
        raw, mode="training", as_of=as_of, known_issuer=known_issuer, keep=[row_id, "label", "certificate_type"]
    )
    table = stratified_split(features, row_id, seed=seed).select(
        row_id, "label", "certificate_type", "split", *C.FEATURE_COLUMNS
    ).cache()
    fitted, results = {}, []
    for name in candidates:
        fitted[name] = fit(table.filter("split = 'train'"), name, seed=seed, trees=trees)
        scored = score(fitted[name], table.filter("split = 'validation'"), version=name)
        results.append(evaluate(scored, name))
    validation = results[0]
    for r in results[1:]:
        validation = validation.unionByName(r)
    # One row per candidate.
    best = max(validation.select("model", "f1").collect(), key=lambda r: (r["f1"], r["model"]))["model"]
    test_scored = score(fitted[best], table.filter("split = 'test'"), version=best)
    labeled = test_scored.withColumn("predicted", (F.col("prediction") == "suspicious").cast("int"))
    return Trained(
        fitted[best], best, validation, evaluate(test_scored, best),
        class_metrics(labeled, "label", "predicted", "certificate_type"),
    )
