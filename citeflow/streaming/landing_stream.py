"""J1 as Structured Streaming: documents arriving as files are landed, with their content.

File source → ``trigger(availableNow=True)`` → ``foreachBatch``. Each micro-batch is
de-duplicated and compared with what is already in the target table: a document that
landed well is skipped; one that failed, or was restricted (``LandConfig.retry_restricted``), is
tried again, and a delivery that is no better than the recorded one writes nothing. So a
re-delivered batch (executor or driver lost between write and commit, or a fresh
checkpoint) is a no-op, and running the job twice lands the same rows as running it
once. The table is append-only; ``operators.landing.current`` reads one row per id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LandConfig
from ..operators import landing
from ..operators.util import kept

SCHEMA = "pmcid string, n_bytes bigint, content string, status string"


def _existing(spark: SparkSession, target: str) -> DataFrame | None:
    """The target table; None only when it does not exist yet (other storage errors surface)."""
    try:
        return spark.read.schema(SCHEMA).parquet(target)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def land_batch(batch: DataFrame, target: str, cfg: LandConfig = LandConfig()) -> None:
    spark = batch.sparkSession
    out = landing.best_deliveries(batch, cfg)  # facts only; the texts follow for what is written
    prior = _existing(spark, target)
    if prior is not None:
        # Only this batch's ids can collide: the landed table is filtered by them first, and
        # only its fixed-width columns are read.
        ids = batch.select("pmcid").distinct()
        rank = landing._rank(F.col("status"))
        before = (prior.select("pmcid", "status").join(ids, "pmcid", "left_semi")
                  .groupBy(F.col("pmcid").alias("_id")).agg(F.max(rank).alias("_before")))
        retried = ["failed"] + (["restricted"] if cfg.retry_restricted else [])
        again = F.col("_before").isNull() | (
            F.col("_before").isin([i + 1 for i, x in enumerate(landing.STATUS_ORDER) if x in retried])
            & (rank > F.col("_before")))
        out = (out.join(before, F.col("pmcid").eqNullSafe(F.col("_id")), "left")
               .withColumn("_again", again).drop("_id", "_before"))
    else:
        out = out.withColumn("_again", F.lit(True))
    out = kept(out, "landing-batch")
    apart = ~F.col("_again") | (F.col("_n") > 1)  # ids whose rows are not simply all written
    n, m = out.agg(F.count_if("_again"), F.count_if(apart)).first()
    if n == 0 and prior is not None:
        return
    if m <= landing.FEW:
        rows = landing.all_but(out.where(apart), batch, cfg)
        if m:
            rows = rows.unionByName(landing.with_texts(out.where("_again and _n > 1"), batch, few=True))
    else:
        rows = landing.with_texts(out.where("_again"), batch, few=n <= landing.FEW)
    # Routed by status (restricted documents land in their own folder).
    rows.write.mode("append").partitionBy("status").parquet(target)


def run(spark: SparkSession, source: DataFrame, target: str, checkpoint: str,
        cfg: LandConfig = LandConfig()) -> None:
    """Drain everything currently available in ``source`` into ``target``."""
    q = (source.writeStream
         .foreachBatch(lambda df, _epoch: land_batch(df, target, cfg))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
