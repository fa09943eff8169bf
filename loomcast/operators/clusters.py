"""Topic clusters of vectors: k-means, members by similarity, labels from frequent terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STOPWORDS
from ..functions.text import cosine


def kmeans(vectors: DataFrame, k: int = 10, restarts: int = 10, seed: int = 42) -> DataFrame:
    """Vectors with their cluster and its centre, from the restart of least cost; fewer clusters for few vectors.

    One vector is a cluster of its own; no vectors give no rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n < 2:
        return vectors.withColumn("cluster", F.lit(0)).withColumn("centre", F.transform("embedding", lambda x: x.cast("double")))
    k = k if n >= k else max(2, n // 5)
    rows = vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.clusterCenters()])  # k rows
    return best.transform(rows).withColumn("centre", F.get(centres, F.col("cluster"))).drop("features")


def members(clustered: DataFrame, least: int = 5) -> DataFrame:
    """Members of clusters that have `least` and more, with their similarity to the centre, most similar first."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    rows = clustered.join(sizes, "cluster").withColumn("similarity", cosine(F.col("embedding"), F.col("centre")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("similarity"), "vec_id"))
    return rows.withColumn("rank", rank)


def top_terms(texts: DataFrame, most: int = 5, first: int = 20) -> DataFrame:
    """The most frequent terms of each cluster's first texts; ties go to the term seen first.

    Terms are words without other than letters and digits, of three characters at least, and no stopwords.
    """
    rows = texts.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("rank"))).where(F.col("rank") <= first)
    words = rows.select("cluster", "rank", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "word"))
    words = words.withColumn("term", F.regexp_replace("word", r"[^\p{L}\p{N}]", "")).where(F.length("term") > 2)
    words = words.where(~F.col("term").isin(*sorted(STOPWORDS)))
    counted = words.groupBy("cluster", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("seen"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "seen"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select("cluster", "term", "n", "place")


def labels(terms: DataFrame) -> DataFrame:
    """The first three terms of each cluster as its label."""
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "term"))), 1, 3), lambda x: x["term"])
    return terms.groupBy("cluster").agg(F.array_join(top, " / ").alias("label"), F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))


def best_cluster(labelled: DataFrame, query: str) -> DataFrame:
    """The cluster whose label (10) and terms (5 each, either way round) answer a query best; no row if none does."""
    q = F.lit(query.lower())
    score = F.when(F.contains(F.lower("label"), q), 10).otherwise(0)
    score = score + F.aggregate("terms", F.lit(0), lambda s, t: s + F.when(F.contains(t, q) | F.contains(q, t), 5).otherwise(0))
    return labelled.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "cluster").limit(1)
