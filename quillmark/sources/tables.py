"""Tables of a folder of Parquet files or datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are long texts, so that the work on a row outweighs moving it.
TEXT_TABLES = frozenset({"documents", "pages"})
#: Input that is moved at most to use all cores.
SPREAD_BYTES = 2 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if it is small.

    A table in one small file is one partition, and its texts would be worked on by one core. Input
    of more than `SPREAD_BYTES`, by the number of its partitions, is not moved.
    """
    spark = df.sparkSession
    cores, parts = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    size = str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")).lower().rstrip("b")
    each = int(size.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    return df.repartition(cores) if parts < cores and parts * each <= SPREAD_BYTES else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
