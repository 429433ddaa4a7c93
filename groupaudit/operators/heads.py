"""Classifier heads from pyspark.ml, calibration inputs, and identity probes.

The linear SVM head lives with the batched linear models."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.operators.inference import rank_average, top_members
from groupaudit.session import materialise

# Hyper-parameters of the heads.
HEADS: dict[str, Callable[[int, int, int], Estimator]] = {
    "logreg": lambda d, n, seed: LogisticRegression(maxIter=500, regParam=1.0 / n, standardization=False),
    "mlp": lambda d, n, seed: MultilayerPerceptronClassifier(layers=[d, 256, 2], maxIter=100, seed=seed),
    "gbt": lambda d, n, seed: GBTClassifier(maxIter=200, stepSize=0.1, seed=seed),
}


def make_head(name: str, d: int, n_train: int, seed: int) -> Estimator:
    if name not in HEADS:
        raise ValueError(f"unknown head {name!r}; known: {sorted(HEADS)}")
    est = HEADS[name](d, n_train, seed)
    return est.setFeaturesCol("features").setLabelCol("label")


ROWS_PER_TASK = 20_000  # below this an iterative fit spends its time on task overhead


def _prepare(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides scaled with training statistics."""
    model = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
    return model.transform(train), model.transform(test)


def fit_predict(name: str, train: DataFrame, test: DataFrame, *, seed: int = 0) -> DataFrame:
    """Test rows with ``p``: scaled on the training side, fitted there only."""
    tr, te = scaled(_prepare(train), _prepare(test))
    n, d = tr.agg(F.count("*"), F.first(F.size("x"))).first()
    data = tr.select("features", "label").coalesce(n // ROWS_PER_TASK + 1).persist()
    model = make_head(name, d, n, seed).fit(data)
    data.unpersist()
    return model.transform(te).select(*test.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def heads_out_of_fold(
    units: DataFrame, folds: DataFrame, *, unit: str, group: str, heads: list[str], seed: int = 0, parallelism: int = 4
) -> DataFrame:
    """(head, repeat, fold, unit_id, group_id, y, p) of pyspark.ml heads.

    The driver iterates over (repeat, fold, head) only, a few fits at a time; every fit and
    transform is distributed.
    """
    data = materialise(units.join(folds.select("repeat", group, "fold"), group))
    cells = [tuple(r) for r in data.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]

    def cell(job: tuple[int, int, str]) -> DataFrame:
        rep, f, h = job
        rows = data.where(F.col("repeat") == rep)
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        return fit_predict(h, train, test, seed=seed + rep).select(
            F.lit(h).alias("head"), "repeat", "fold", F.col(unit).cast("string").alias("unit_id"),
            F.col(group).cast("string").alias("group_id"), "y", "p",
        )

    with ThreadPool(parallelism) as pool:
        parts = pool.map(cell, [(rep, f, h) for rep, f in cells for h in heads])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialise(out)


def rank_ensemble(oof: DataFrame, inner_auc: DataFrame, *, n: int = 3) -> DataFrame:
    """Rank average of the heads with the best training-only inner AUC, per (repeat, fold)."""
    members = top_members(inner_auc, fold=["repeat", "fold"], head="head", auc="auc", n=n)
    return rank_average(oof, members, fold=["repeat", "fold"], head="head", unit="unit_id")


def identity_probe(units: DataFrame, *, group: str) -> DataFrame:
    """Accuracy of telling groups apart (``is_train`` marks the training half) beside chance 1 / n."""
    # the probe's few sampled groups become class numbers
    names = [r[0] for r in units.select(group).distinct().orderBy(group).collect()]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group)) - 1
    data = units.withColumn("label", code.cast("double")).withColumn("raw", array_to_vector("x"))
    tr, te = scaled(data.where("is_train"), data.where("NOT is_train"))
    n = tr.count()
    model = LogisticRegression(maxIter=200, regParam=1.0 / n, standardization=False, family="multinomial").fit(
        tr.select("features", "label")
    )
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return model.transform(te).agg(
        F.avg(hit).alias("accuracy"),
        F.lit(1 / len(names)).alias("chance"),
        F.lit(len(names)).alias("n_ways"),
        F.count("*").alias("n_test"),
    )


def isotonic(train: DataFrame, test: DataFrame, *, p: str = "p", label: str = "y") -> DataFrame:
    """Isotonic calibration fitted on ``train`` and applied to ``test``."""
    cast = lambda d: d.withColumn("features", F.col(p)).withColumn("label", F.col(label).cast("double"))
    model = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="p_cal").fit(cast(train))
    return model.transform(cast(test)).drop("features", "label")


def calibration_features(p: str = "p") -> dict[str, list]:
    """Inputs that turn a logistic fit into each calibrator."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    logit = F.log(q / (1 - q))
    return {"temperature": [logit], "platt": [logit], "beta": [F.log(q), -F.log(1 - q)]}
