"""Unsupervised map of series by their descriptors, reused on a second set of series."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import keep
from tidemark.operators.distribution import DESCRIPTORS


def fit_clusters(desc: DataFrame, k: int = 3, starts: int = 20, seed: int = 42):
    """Standardise, then k-means with the best of several starts, then two principal components."""
    rows = keep(desc.dropna(subset=DESCRIPTORS))
    prep = Pipeline(stages=[
        VectorAssembler(inputCols=DESCRIPTORS, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True),
    ]).fit(rows)
    z = keep(prep.transform(rows))
    best: KMeansModel | None = None
    for i in range(starts):
        m = KMeans(k=k, seed=seed + i, featuresCol="_z", predictionCol="cluster").fit(z)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    pca = PCA(k=2, inputCol="_z", outputCol="_pc").fit(z)

    def assign(other: DataFrame) -> DataFrame:
        d = pca.transform(best.transform(prep.transform(other.dropna(subset=DESCRIPTORS))))
        pc = vector_to_array("_pc")
        return d.select("env", "series_id", *DESCRIPTORS, "cluster",
                        pc[0].alias("pc1"), pc[1].alias("pc2"))

    assign.explained = [float(v) for v in pca.explainedVariance]
    return assign


def cluster_shares(assigned: DataFrame) -> DataFrame:
    """Percent of each environment's series per cluster."""
    n = assigned.groupBy("env", "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("env"))  # a row per cluster
    return n.select("env", "cluster", "n", (100 * F.col("n") / total).alias("pct"))
