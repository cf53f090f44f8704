"""Id crosswalk (S3 phase 1): ids → first catalogue answer → mapped / unmapped
(A3, A6, C2, C20, C23, D17, E6, G1, F13, B3), kept between runs (J1)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pmc_ref
from ..session import shared_dir


def first_answer(answers: DataFrame, key: str = "pmid", value: str = "pmcid",
                 order: str = "ord") -> DataFrame:
    """Keep the first answer per key.

    ``min_by`` is a partially aggregated hash aggregate, so a key with a huge
    number of answers is pre-reduced on the map side instead of being gathered
    into one task the way a window ``row_number`` would."""
    return answers.groupBy(key).agg(F.min_by(value, order).alias(value))


def crosswalk(ids: DataFrame, answers: DataFrame, id_col: str = "id") -> DataFrame:
    """Every requested id with its first answer (NULL when unmapped)."""
    first = first_answer(answers)
    x = ids.select(F.col(id_col).alias("pmid")).join(first, "pmid", "left")
    return x.select("pmid", F.nullif(F.col("pmcid"), F.lit("")).alias("pmcid"))


def identity_crosswalk(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that already are catalogue ids map to themselves."""
    return ids.select(F.col(id_col).alias("pmid"), F.col(id_col).alias("pmcid"))


def mapped(xwalk: DataFrame) -> DataFrame:
    """Mapped rows with the prefixed catalogue reference."""
    return xwalk.where(F.col("pmcid").isNotNull()).select(
        "pmid", "pmcid", pmc_ref(F.col("pmcid")).alias("pmc_ref"))


def unmapped(xwalk: DataFrame) -> DataFrame:
    """q15: ids without an answer."""
    return xwalk.where(F.col("pmcid").isNull()).select("pmid")


def coverage(xwalk: DataFrame) -> DataFrame:
    """processed and mapped counts."""
    return xwalk.agg(F.count("*").alias("processed"), F.count("pmcid").alias("mapped"))


# --- a mapping that is kept (J1) ------------------------------------------------

#: Partitions of the kept mapping; an update rewrites those its new ids fall into.
BUCKETS = 64
KEPT_SCHEMA = "pmid string, pmcid string, bucket int"


def kept_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, pmcid, bucket) of the mapping at ``path``; empty when there is none yet."""
    try:
        return spark.read.schema(KEPT_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEPT_SCHEMA)


def update_mapping(ids: DataFrame, answers: DataFrame, path: str, id_col: str = "id", whole: bool = False) -> DataFrame:
    """Add first answers of ids that are not mapped yet to the mapping at ``path``, and return it.

    What is mapped stays as it is, whatever the new answers say, so a second run with the same ids writes nothing. Ids
    without an answer are asked for again the next time. With ``whole`` a mapping that holds anything is
    taken as complete and nothing is asked at all. Only the partitions of new ids are rewritten, by
    dynamic overwrite from a staged copy; the mapping's ids move only within those.
    """
    spark = ids.sparkSession
    before = kept_mapping(spark, path)
    if whole and not before.isEmpty():
        return before.select("pmid", "pmcid")
    bucket = F.pmod(F.xxhash64("pmid"), F.lit(BUCKETS)).cast("int")
    asked = ids.select(F.col(id_col).alias("pmid")).distinct().withColumn("bucket", bucket)
    open_ids = asked.join(before.select("pmid", "bucket"), ["bucket", "pmid"], "left_anti").select("pmid")
    new = (mapped(crosswalk(open_ids, answers, "pmid")).select("pmid", "pmcid").withColumn("bucket", bucket))
    staged = shared_dir(spark, "mapping")
    new.write.partitionBy("bucket").parquet(f"{staged}/new")
    new = spark.read.schema(KEPT_SCHEMA).parquet(f"{staged}/new")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    if touched:
        both = new.unionByName(before.where(F.col("bucket").isin(touched)))
        both.repartition("bucket").write.partitionBy("bucket").parquet(f"{staged}/both")
        (spark.read.schema(KEPT_SCHEMA).parquet(f"{staged}/both").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return kept_mapping(spark, path).select("pmid", "pmcid")
