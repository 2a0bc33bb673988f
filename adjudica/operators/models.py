"""The claim filter and failure models, and routing between two models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.features import FeaturePipeline
from adjudica.functions.scalar import bucket


def assembled(df: DataFrame, pipeline: FeaturePipeline) -> DataFrame:
    """Features as a vector, in the order of their names."""
    names = sorted(pipeline.columns(df))
    return VectorAssembler(inputCols=names, outputCol="features").transform(pipeline.run(df))


def train_filter(df: DataFrame, label: str, pipeline: FeaturePipeline | None = None, trees: int = 100, seed: int = 42) -> tuple[Transformer, float]:
    """A random forest on 80 of 100 rows and its accuracy on the others. Fitting reads its rows several times, so features and
    labels are kept, on disk where memory ends, and df is computed once."""
    data = assembled(df, pipeline or FeaturePipeline()).select("features", F.col(label).cast("double").alias("label")).persist()
    try:
        train, test = data.randomSplit([0.8, 0.2], seed=seed)
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(train)
        return model, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))
    finally:
        data.unpersist()


def predict_filter(df: DataFrame, model: Transformer | Callable[[pd.DataFrame], pd.Series] | None, pipeline: FeaturePipeline | None = None) -> DataFrame:
    """filter_number of each claim: 0 without a model; a Spark model, or any function of a pandas frame."""
    if model is None:
        return df.withColumn("filter_number", F.lit(0))
    pipeline = pipeline or FeaturePipeline()
    if isinstance(model, Transformer | PipelineModel):
        names = [*df.columns, "filter_number"]
        return model.transform(assembled(df, pipeline)).withColumn("filter_number", F.col("prediction").cast("int")).select(*names)
    features = pipeline.columns(df)

    def run(frame: pd.DataFrame) -> pd.Series:
        return model(frame)

    # only the features travel to Python
    return df.withColumn("filter_number", F.pandas_udf(run, "int")(F.struct(*[features[n].alias(n) for n in sorted(features)])))


def failure_probability(df: DataFrame, label: str, pipeline: FeaturePipeline | None = None) -> DataFrame:
    """p_fail by logistic regression on the same rows."""
    data = assembled(df.withColumn("label", F.col(label).cast("double")), pipeline or FeaturePipeline())
    model = LogisticRegression(maxIter=20).fit(data)
    return model.transform(data).withColumn("p_fail", vector_to_array("probability")[1]).select(*df.columns, "p_fail")


def ab_variant(key: Column, ratio: float) -> Column:
    """Variant a for about `ratio` of the keys, the same in every run."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio has to lie between 0 and 1")
    return F.when(bucket(key, 10_000) < round(ratio * 10_000), "a").otherwise("b")


def ab_predict(df: DataFrame, a, b, key: str, ratio: float) -> DataFrame:
    """Each claim's variant and the filter number of that variant's model."""
    own = df.withColumn("variant", ab_variant(F.col(key), ratio))
    return predict_filter(own.where("variant = 'a'"), a).unionByName(predict_filter(own.where("variant = 'b'"), b))
