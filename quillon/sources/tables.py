"""Reading, writing and making tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, folder: str, names=TABLES) -> None:
    """Temporary views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, a file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line and a stated schema: no pass to infer one."""
    return spark.read.option("header", True).schema(schema).csv(path)


def generated_vectors(spark: SparkSession, n: int, dimensions: int, clusters: int = 0, seed: int = 1) -> DataFrame:
    """(id, embedding): uniform in +-0.5, or around ``clusters`` centroids with noise in +-0.125; the same for a seed.

    Values come from hashes of (seed, id, position), so any partition can be made again alone.
    """
    unit = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)
    ids = spark.range(1, n + 1).toDF("id")
    spots = F.sequence(F.lit(0), F.lit(dimensions - 1))
    if not clusters:
        value = lambda i: (unit(F.lit(seed), F.col("id"), i) - 0.5).cast("float")
    else:
        centre = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(clusters))
        value = lambda i: (unit(F.lit(seed + 1), centre, i) - 0.5 + (unit(F.lit(seed + 2), F.col("id"), i) - 0.5) / 4).cast("float")
    return ids.withColumn("embedding", F.transform(spots, value))
