"""Metrics of predictions: a table with y_true, y_pred and, where they are read, scores as an array in the order of the labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, by: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    """(by..., y_true, y_pred, n) in long form, zeros included for the labels: those given, else all that occur within a `by` group.

    Given labels are the whole list: a prediction outside it is counted in no cell.
    """
    cells = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    if labels is None:
        seen = cells.select(*by, F.explode(F.array("y_true", "y_pred")).alias("l"))
        known = seen.groupBy(*by).agg(F.array_sort(F.collect_set("l")).alias("ls"))
    else:
        groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
        known = groups.select("*", F.array(*[F.lit(x) for x in labels]).alias("ls"))
    every = known.select(*by, F.explode("ls").alias("y_true"), "ls").select(*by, "y_true", F.explode("ls").alias("y_pred"))
    return every.join(cells, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where there is nothing to divide by."""
    both = matrix.select(*by, F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("h")).unionByName(
        matrix.select(*by, F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("h"))
    )
    sums = both.groupBy(*by, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.withColumn("precision", rate("hits", "predicted")).withColumn("recall", rate("hits", "support"))
    both_rates = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both_rates > 0, 2 * F.col("precision") * F.col("recall") / both_rates).otherwise(0.0))


def summary(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, balanced accuracy (the mean recall of all labels of the matrix, 0 for a label that no row truly has), macro and weighted F1."""
    n = F.sum("support")
    return classes.groupBy(*by).agg(
        n.alias("n"),
        (F.sum("hits") / n).alias("accuracy"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def log_loss(score: Column, clip: float = 1e-15) -> Column:
    """One sample's loss from the score of its true label."""
    return -F.log(F.greatest(F.least(score, F.lit(1.0)), F.lit(clip)))


def brier(scores: Column, truth: Column) -> Column:
    """One sample's squared distance between its scores and the truth, whose place in them (from 1) is given."""
    return F.aggregate(F.transform(scores, lambda p, i: (p - F.when(i + 1 == truth, 1.0).otherwise(0.0)) * (p - F.when(i + 1 == truth, 1.0).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x)


def reliability(predictions: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, mean_confidence, accuracy) with a row for every bin; columns confidence and correct (0 or 1). The last bin is closed."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    filled = predictions.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"))
    groups = predictions.select(*by).distinct() if by else predictions.sparkSession.range(1).select()
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(filled, [*by, "bin"], "left").na.fill(0, ["n"])


def calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: the mean gap of the bins of a reliability table, weighted by their counts."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")
    return table.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def by_unit(predictions: DataFrame, unit: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One prediction for each unit: the mean of its members' scores, the first label of the largest mean; an error if members differ in truth."""
    means = F.array(*[F.avg(F.element_at("scores", i + 1)) for i in range(len(labels))])
    table = predictions.groupBy(*by, unit).agg(means.alias("scores"), F.min("y_true").alias("y_true"), F.countDistinct("y_true").alias("_t"), F.count("*").alias("n_members"))
    pure = F.when(F.col("_t") > 1, F.raise_error(F.concat(F.lit("members of a unit differ in truth: "), F.col(unit).cast("string"))).cast("string")).otherwise(F.col("y_true").cast("string"))
    names = F.array(*[F.lit(x) for x in labels])
    return table.withColumn("y_true", pure).withColumn("y_pred", F.element_at(names, F.array_position("scores", F.array_max("scores")).cast("int"))).drop("_t")


def class_weights(samples: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): all / (labels * own count)."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))  # a row for each label
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
