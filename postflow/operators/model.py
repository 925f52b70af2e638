"""Learned sentiment models with the same output as the lexicon."""

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, functions as F

from postflow.functions.text import tokens
from postflow.staging import stage


SCALE = 1_000_000  # log-odds are kept as whole millionths, so that sums do not depend on their order


def fit_naive_bayes(labelled: DataFrame, smoothing: int = 100, min_posts: int = 3) -> tuple[DataFrame, int]:
    """`(term, polarity, posts)` and a bias for `labeller`, from posts with `cleaned_text` and a label `toxic`, 0 or 1.

    Naive Bayes over the presence of terms, in closed form: a term's polarity is the log-odds that
    a post with it is not toxic, after `smoothing` posts with the term's overall share were added to
    either kind; the bias is the log-odds of a post. Terms in fewer than `min_posts` posts tell
    nothing. Null texts and other labels do not count.
    """
    posts = labelled.where(F.col("toxic").isin(0, 1) & F.col("cleaned_text").isNotNull())
    toxic, other = posts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    good, bad = F.col("_good"), F.col("_bad")
    added = smoothing * (good + bad) / max(toxic + other, 1)
    odds = F.log((good + added) / (other + smoothing)) - F.log((bad + added) / (toxic + smoothing))
    terms = (
        posts.select("toxic", F.explode(F.array_distinct(tokens(F.col("cleaned_text")))).alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("toxic") == 0).alias("_good"), F.count_if(F.col("toxic") == 1).alias("_bad"))
        .where(good + bad >= min_posts)
        .select("term", F.round(odds * SCALE).cast("bigint").alias("polarity"), (good + bad).alias("posts"))
    )
    return terms, round(math.log((other + 1) / (toxic + 1)) * SCALE)


def fit_sentiment(
    labelled: DataFrame, path: str, toxic_weight: float = 7.0, features: int = 1 << 14
) -> PipelineModel:
    """Fit a sparse logistic regression on posts with `cleaned_text` and a label `toxic`, 0 or 1,
    in batch, and store it at `path`.

    Toxic posts are rare, so they weigh more; the L1 penalty keeps the few telling words. The
    model is read back for use: the fitted one drags its training data's plan into every task.
    """
    hashing = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=features, binary=True)
    # Written once, as every iteration of the fit may read the features again.
    train = stage(
        hashing.transform(_with_terms(labelled)).select(
            "_features",
            F.col("toxic").cast("double").alias("toxic"),
            F.when(F.col("toxic") == 1, toxic_weight).otherwise(1.0).alias("weight"),
        ),
        "sentiment-features",
    )
    regression = LogisticRegression(
        featuresCol="_features", labelCol="toxic", weightCol="weight",
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_toxic",
        elasticNetParam=1.0, regParam=0.05,
    )
    PipelineModel([hashing, regression.fit(train)]).write().overwrite().save(path)
    return PipelineModel.load(path)


def label_with_model(posts: DataFrame, model: PipelineModel) -> DataFrame:
    """`posts` with `sentiment_result`; batch or stream. Null text has a null array."""
    label = F.when(F.col("_toxic") == 1, "neg").otherwise("pos")
    return (
        model.transform(_with_terms(posts))
        .withColumn("sentiment_result", F.when(F.col("cleaned_text").isNotNull(), F.array(label)))
        .select(*posts.columns, "sentiment_result")
    )


def _with_terms(df: DataFrame) -> DataFrame:
    return df.withColumn("_terms", tokens(F.coalesce(F.col("cleaned_text"), F.lit(""))))
