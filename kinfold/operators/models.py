"""Out-of-fold predictions of linear models on vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic_fold(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 1.0, weight: str | None = None) -> DataFrame:
    """test with y_true, y_pred and scores, by standardised multinomial logistic regression fitted on train alone.

    The penalty is that of C * sum of losses + half the squared norm: regParam is 1 / (C * total weight) without Spark's own standardisation.
    """
    total = train.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
    model = LogisticRegression(featuresCol="_x", labelCol="_label", family="multinomial", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
    if weight:
        model = model.setWeightCol(weight)
    as_vector = lambda df: df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    fitted = Pipeline(stages=[*stages, model]).fit(as_vector(train))
    names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
    out = fitted.stages[2].transform(fitted.stages[1].transform(as_vector(test)))
    return out.select(*test.columns, F.col(label).cast("string").alias("y_true"), F.element_at(names, F.col("_y").cast("int") + 1).alias("y_pred"), vector_to_array("_p").alias("scores"))


def out_of_fold(samples: DataFrame, vector: str, label: str, fold: str = "fold", c: float = 1.0) -> DataFrame:
    """Every sample's prediction by the model that did not see its fold. One fit for each fold; each is distributed."""
    out = None
    for f in sorted(r[0] for r in samples.select(fold).distinct().collect()):
        part = logistic_fold(samples.filter(F.col(fold) != f), samples.filter(F.col(fold) == f), vector, label, c)
        out = part if out is None else out.unionByName(part)
    return out


def linear_svm(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 1.0) -> DataFrame:
    """test with y_pred by one-against-the-rest linear support vectors (hinge loss)."""
    as_vector = lambda df: df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(as_vector(train))
    rest = OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * max(1, train.count())), maxIter=100), featuresCol="_x", labelCol="_label", predictionCol="_y")
    names = F.array(*[F.lit(x) for x in index.labels])
    fitted = rest.fit(scale.transform(as_vector(index.transform(train))))
    return fitted.transform(scale.transform(as_vector(test))).select(*test.columns, F.col(label).cast("string").alias("y_true"), F.element_at(names, F.col("_y").cast("int") + 1).alias("y_pred"))


def metadata_features(table: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """table with features: numbers with the exact median for missing ones, centred and divided by their population deviation
    (1 where there is none); categories one-hot, unknown ones all zeros."""
    medians = table.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in numeric]).first()
    filled = table.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(f"_{c}_n") for c in numeric], *[F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("missing")).alias(f"_{c}") for c in categorical])
    of = filled.agg(*[x for c in numeric for x in (F.coalesce(F.avg(f"_{c}_n"), F.lit(0.0)).alias(f"m_{c}"), F.coalesce(F.stddev_pop(f"_{c}_n"), F.lit(0.0)).alias(f"s_{c}"))]).first()
    scaled_numbers = filled.withColumns({f"_{c}_s": (F.col(f"_{c}_n") - of[f"m_{c}"]) / (of[f"s_{c}"] or 1.0) for c in numeric})
    stages = [
        *[StringIndexer(inputCol=f"_{c}", outputCol=f"_{c}_i", handleInvalid="keep") for c in categorical],
        OneHotEncoder(inputCols=[f"_{c}_i" for c in categorical], outputCols=[f"_{c}_h" for c in categorical], dropLast=True),
        VectorAssembler(inputCols=[*[f"_{c}_s" for c in numeric], *[f"_{c}_h" for c in categorical]], outputCol="_features"),
    ]
    out = Pipeline(stages=stages).fit(scaled_numbers).transform(scaled_numbers)
    return out.select(*table.columns, vector_to_array("_features").alias("features"))


def centroids(samples: DataFrame, vector: str, label: str, size: int) -> DataFrame:
    """(label, centroid): means by component."""
    return samples.groupBy(F.col(label).alias("c_label")).agg(F.array(*[F.avg(F.element_at(vector, i + 1).cast("double")) for i in range(size)]).alias("centroid"))


def scaled(train: pd.DataFrame, test: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both tables centred and scaled by the training rows alone (population deviation; 1 where there is none)."""
    mean, sd = train.to_numpy(float).mean(0), train.to_numpy(float).std(0)
    sd[sd == 0] = 1.0
    return (train.to_numpy(float) - mean) / sd, (test.to_numpy(float) - mean) / sd
