"""Weights of sparse features (read_id, feature_id, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = ("count", "binary", "tf", "idf", "tfidf", "smooth_idf")


def _frequencies(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_id").agg(F.count_distinct("read_id").alias("df"))


def _idf(features: DataFrame) -> DataFrame:
    n = features.agg(F.count_distinct("read_id").cast("double").alias("n_reads"))
    return _frequencies(features).crossJoin(F.broadcast(n)).withColumn("idf", F.log(F.col("n_reads") / (F.col("df") + 1e-12)))  # one row


def weighted(features: DataFrame, method: str) -> DataFrame:
    """(read_id, feature_id, weight) by count, binary, tf, idf, tfidf or smooth_idf."""
    cnt = F.col("cnt").cast("double")
    share = cnt / F.sum("cnt").over(Window.partitionBy("read_id"))
    if method == "count":
        return features.select("read_id", "feature_id", cnt.alias("weight"))
    if method == "binary":
        return features.select("read_id", "feature_id", F.when(cnt > 0, 1.0).otherwise(0.0).alias("weight"))
    if method == "tf":
        return features.select("read_id", "feature_id", share.alias("weight"))
    if method == "idf":
        return features.join(_idf(features), "feature_id").select("read_id", "feature_id", F.col("idf").alias("weight"))
    if method == "tfidf":
        return features.withColumn("tf", share).join(_idf(features), "feature_id").select("read_id", "feature_id", (F.col("tf") * F.col("idf")).alias("weight"))
    if method == "smooth_idf":
        rated = _idf(features).select("feature_id", (F.log((F.col("n_reads") + 1) / (F.col("df") + 1)) + 1).alias("weight"))
        return features.join(rated, "feature_id").select("read_id", "feature_id", "weight")
    raise ValueError(f"unknown weighting {method!r}; one of {', '.join(NAMES)}")


def fitted_tfidf(reference: DataFrame, query: DataFrame) -> DataFrame:
    """Smoothed TF-IDF fitted on ``reference`` and applied to ``query``, rows scaled to length one."""
    rated = _idf(reference).select("feature_id", (F.log((F.col("n_reads") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = query.join(rated, "feature_id").select("read_id", "feature_id", (F.col("cnt") * F.col("idf")).alias("w"))
    return raw.select("read_id", "feature_id", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("read_id")))).alias("weight"))
