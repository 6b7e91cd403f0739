"""Models over feature columns: clusters, logistic regression out of fold, boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import fold


def nearest_to_centroid(df: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Of each label the row nearest to its mean. Means are added up in place, partially on each task."""
    size = df.select(F.size(vector).alias("n")).filter("n > 0").limit(1).collect()
    n = size[0]["n"] if size else 0
    means = df.groupBy(label).agg(F.array(*[F.avg(F.get(vector, i).cast("double")) for i in range(n)]).alias("__c"))
    far = F.aggregate(F.zip_with(vector, "__c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    near = df.join(means, label).groupBy(label).agg(F.min(F.struct(F.round(far, 6).alias("d"), F.col(key))).alias("b"))
    return near.select(label, F.col(f"b.{key}").alias(key))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    x = df.select(key, array_to_vector(F.col(vector)).alias("raw"))
    x = Normalizer(inputCol="raw", outputCol="features").transform(x)
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    logs = df.select("*", *[F.log1p(F.greatest(F.lit(0.0), F.col(f))).alias(f"__{f}") for f in features])
    return VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="raw").transform(logs)


def out_of_fold(df: DataFrame, key: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """Scores of a balanced logistic regression on scaled log features, each row by a model that didn't see its fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df, features).withColumn("fold", fold(F.col(key), folds))
    out = None
    for i in range(folds):
        train = x.filter(F.col("fold") != i)
        share = train.agg(F.avg(label).alias("p")).first()["p"] or 0.5
        train = train.withColumn("w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
        model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="w", regParam=0.01)]).fit(train)
        got = model.transform(x.filter(F.col("fold") == i)).select(key, "fold", F.get(vector_to_array("probability"), 1).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def boosted_importance(df: DataFrame, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """(feature, importance) of boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    model = GBTClassifier(labelCol=label, maxIter=5, seed=seed).fit(x)
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
