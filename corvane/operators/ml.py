"""Model operators: tree ensembles from JSON, random forests, thresholded labels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mean_skip_null

#: The quality classes in the order in which ties are resolved, and the one that stands for no class.
CLASSES = ("LQ", "AQ", "MQ", "HQ")
#: The forest's features, and where those that tables name otherwise come from.
FEATURES = ("plddt", "cdr1a_plddt", "cdr1b_plddt", "cdr2a_plddt", "cdr2b_plddt", "cdr3a_plddt", "cdr3b_plddt", "peptide_plddt", "iptm_mean", "ptm_mean", "pdockq", "avgipde", "avgipae", "avgpdockq2")
MEANS = {"avgipde": ("avgipde_a", "avgipde_b"), "avgipae": ("avgipae_a", "avgipae_b"), "avgpdockq2": ("pdockq2_a", "pdockq2_b")}


def quality_features(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with aliased features and null-skipping means of pairs, made only where they aren't there."""
    for name, source in (aliases or {}).items():
        if name not in df.columns and source in df.columns:
            df = df.withColumn(name, F.col(source))
    for name, (a, b) in MEANS.items():
        if name not in df.columns and {a, b} <= set(df.columns):
            df = df.withColumn(name, mean_skip_null(F.col(a), F.col(b)))
    return df


def train_forest(df: DataFrame, features: list[str], label: str = "Quality", classes: tuple[str, ...] = CLASSES, trees: int = 1000, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    """A random forest with balanced class weights; classes are numbered in the order given."""
    rows = df.dropna(subset=[*features, label])
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, total / (len(counts) * n))])
    rows = rows.select(array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"), number.cast("double").alias("label"), F.try_element_at(weight, F.col(label)).alias("weight"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="log2", weightCol="weight", seed=seed).fit(rows)


def forest_predict(df: DataFrame, model: RandomForestClassificationModel, features: list[str], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``df`` with predicted_label and proba_<class>."""
    rows = df.withColumn("features__", array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])))
    got = model.copy({model.featuresCol: "features__", model.probabilityCol: "p__", model.predictionCol: "k__", model.rawPredictionCol: "raw__"}).transform(rows)
    got = got.withColumn("p__", vector_to_array("p__")).withColumn("predicted_label", F.get(F.array(*[F.lit(c) for c in classes]), F.col("k__").cast("int")))
    return got.select("*", *[F.coalesce(F.get("p__", F.lit(i)), F.lit(0.0)).alias(f"proba_{c}") for i, c in enumerate(classes)]).drop("features__", "p__", "k__", "raw__")


def thresholded_label(probas: dict[str, Column], passes: dict[str, Column], classes: tuple[str, ...] = CLASSES) -> Column:
    """The class of the largest probability among those that pass; ties go to the first class, none gives the first."""
    best = F.greatest(*[F.when(passes[c], probas[c]).otherwise(F.lit(-1.0)) for c in classes])
    out = F.lit(classes[0])
    for c in reversed(classes):
        out = F.when(passes[c] & (probas[c] == best), F.lit(c)).otherwise(out)
    return out


def label_thresholds(df: DataFrame, thresholds: dict[str, float], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``df`` (with proba_<class>) with pass_<class>, predicted_label_thresholded and pass_filter (any but the first)."""
    probas = {c: F.col(f"proba_{c}") for c in classes}
    passes = {c: F.coalesce(probas[c] >= thresholds[c], F.lit(False)) if c in thresholds else F.lit(True) for c in classes}
    label = thresholded_label(probas, passes, classes)
    return df.select("*", *[passes[c].cast("int").alias(f"pass_{c}") for c in thresholds], label.alias("predicted_label_thresholded"), label.isin(*classes[1:]).cast("int").alias("pass_filter"))


class TreeEnsemble:
    """Boosted trees in the public JSON layout of gradient boosting models, evaluated level by level over whole batches."""

    def __init__(self, text: str):
        model = json.loads(text)["learner"]
        raw = model["learner_model_param"]["base_score"]
        self.base = float(str(raw).strip("[]"))
        self.logistic = "logistic" in model.get("objective", {}).get("name", "binary:logistic")
        self.trees = [{k: np.asarray(t[k]) for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")} for t in model["gradient_booster"]["model"]["trees"]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x), dtype=np.float32)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = t["left_children"][at] >= 0
                if not inner.any():
                    break
                value = x[rows, t["split_indices"][at]]
                left = np.where(np.isnan(value), t["default_left"][at].astype(bool), value < t["split_conditions"][at].astype(np.float32))
                at = np.where(inner, np.where(left, t["left_children"][at], t["right_children"][at]), at)
            total += t["split_conditions"][at].astype(np.float32)
        if not self.logistic:
            return total + self.base
        margin = np.log(self.base / (1 - self.base)) if 0 < self.base < 1 else 0.0
        return 1 / (1 + np.exp(-(total + margin)))


def tree_predict(df: DataFrame, model_json: str, id_col: str = "tcr_id", vector_col: str = "x", out: str = "probs") -> DataFrame:
    """id and ``out``, the ensemble's prediction; the model goes to the workers once. Null values count as missing."""
    shared = df.sparkSession.sparkContext.broadcast(model_json)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = TreeEnsemble(shared.value)
        for rows in batches:
            if len(rows):
                x = np.array([[np.nan if v is None else v for v in r] for r in rows[vector_col]], dtype=np.float32)
                yield pd.DataFrame({id_col: rows[id_col], out: model.predict(x).astype(np.float32)})

    return df.select(id_col, vector_col).mapInPandas(run, f"`{id_col}` {kind}, `{out}` float")


def ranked(predictions: DataFrame, score: str = "probs", id_col: str = "tcr_id") -> DataFrame:
    """Best first; ties by id."""
    return predictions.orderBy(F.desc(score), id_col)
