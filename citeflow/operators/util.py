"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure CPU-heavy per-row work (regex over whole texts) runs on at
    least ``min_partitions`` tasks (default: the session's parallelism).

    A large input already scans as many splits and is returned untouched (no
    shuffle); only an input that arrives as a few big splits is redistributed
    round-robin, which costs one pass over data that fits in a few tasks.
    """
    spark = df.sparkSession
    n = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the
    cluster's shared checkpoint folder (``spark.checkpoint.dir``), so later
    readers — including scalar subqueries over it — never recompute the
    upstream joins, and a lost executor does not force a recomputation."""
    from ..session import shared_dir
    shared_dir(df.sparkSession, "ckpt")  # makes sure the checkpoint dir is set
    return df.checkpoint(eager=True)


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Compute ``df`` once as compressed Parquet in the cluster's shared folder and read it back. For large
    tables: far fewer bytes than a checkpoint, and later readers take only the columns they need."""
    from ..session import shared_dir
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(sorted_df: DataFrame, name: str = "rank") -> DataFrame:
    """1-based position of every row of a globally sorted DataFrame,
    computed without a single-partition window.

    The sorted rows are checkpointed (fixed partitions and order), each row is
    tagged with its partition and its position inside it, partition sizes are
    turned into offsets over a table with one row per partition (bounded by
    the partition count, hence a safe broadcast), and rank = offset + position.
    """
    from pyspark.sql import Window
    ck = materialize(sorted_df)
    tagged = ck.select("*", F.spark_partition_id().alias("_p"),
                       F.monotonically_increasing_id().alias("_m"))
    counts = tagged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
                         F.lit(0)).alias("_off"))
    pos = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_p")
            .select(*ck.columns, (F.col("_off") + pos + 1).alias(name)))


def latest(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Exactly one row per key: the last delivery (largest ``order``) — I5, last write wins.

    Among rows equal in ``order`` (or all rows of the key when there is none) the one with the
    largest hash of its columns stays, and of identical rows one. The aggregate is fixed-width;
    only rows that still tie, identical ones, are de-duplicated as a whole."""
    rank = F.struct(*([F.col(order).alias("o")] if order else []), F.xxhash64(*df.columns).alias("h"))
    best = df.groupBy(F.col(key).alias("_best_key")).agg(F.max(rank).alias("_best"))
    kept = df.join(best, F.col(key).eqNullSafe(F.col("_best_key")) & (rank == F.col("_best")))
    return kept.dropDuplicates([key]).select(*df.columns)
