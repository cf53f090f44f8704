"""Incremental document landing (S3 phase 2): status per document, resume by
skip, routing of restricted documents (D14, D15, D16, E7, F12, B4, J1, T14, T21)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LandConfig
from .util import kept


def landed_nonempty(landed: DataFrame) -> DataFrame:
    """Targets that exist and are non-empty (``[[ -s file ]]``)."""
    return landed.where(F.col("n_bytes") > 0).select("pmcid").distinct()


def keep_bucketed(landed: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The landed ids kept as a table in buckets of the id. A later ``pending`` reads the buckets where they are
    and shuffles the requested ids alone; choose as many buckets as the shuffle has partitions, or more."""
    spark = landed.sparkSession
    name = "landed_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (landed.select("pmcid", "n_bytes").repartition(n, "pmcid").write.bucketBy(n, "pmcid").sortBy("pmcid")
     .option("path", path).mode("overwrite").saveAsTable(name))
    return spark.table(name)


def pending(todo: DataFrame, landed: DataFrame, restricted: DataFrame | None = None,
            cfg: LandConfig = LandConfig()) -> DataFrame:
    """Ids still to fetch — de-duplicated, minus non-empty landed ones.

    Restricted documents were routed away, so by default (T14) they are tried
    again; with ``cfg.retry_restricted`` off, the ``restricted`` ids are skipped."""
    # an anti join asks only whether an id is there, so the landed side needs no distinct
    out = todo.select("pmcid").distinct().join(landed.where(F.col("n_bytes") > 0).select("pmcid"), "pmcid", "left_anti")
    if restricted is not None and not cfg.retry_restricted:
        out = out.join(restricted.select("pmcid").distinct(), "pmcid", "left_anti")
    return out


#: Statuses from worst to best; a landed document is never replaced by a worse delivery.
STATUS_ORDER = ("failed", "restricted", "ok")


def _rank(status):
    return F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), status)


def land(todo: DataFrame, landed: DataFrame, cfg: LandConfig = LandConfig(), content: bool = False) -> DataFrame:
    """Status of every requested document: skipped / restricted / ok / failed.

    ``todo``: (pmcid, content) where content is what the fetch returned.
    ``landed``: (pmcid, n_bytes) of targets already present. With ``content`` the
    document itself comes along (B4). Restricted documents are routed away, so they are not
    "landed" for a later run (T14, ``retry_restricted``).
    """
    present = landed_nonempty(landed).select("pmcid", F.lit(True).alias("_present"))
    status = F.when(F.col("_present").isNotNull(), "skipped").otherwise(F.col("status"))
    t = best_deliveries(todo, cfg).join(present, "pmcid", "left").select("pmcid", status.alias("status"), "n_bytes", "_hash")
    return with_texts(t, todo) if content else t.drop("_hash")


def _facts(cfg: LandConfig):
    """(text, bytes, status) of a delivery by itself."""
    text = F.coalesce(F.col("content"), F.lit(""))
    n_bytes = F.octet_length(text).cast("bigint")
    return text, n_bytes, F.when(text.contains(cfg.needle), "restricted").when(n_bytes > 0, "ok").otherwise("failed")


def best_deliveries(todo: DataFrame, cfg: LandConfig = LandConfig()) -> DataFrame:
    """(pmcid, status, n_bytes, _hash, _n) of every id's best delivery, _n being its deliveries. The aggregate carries
    fixed-width facts only."""
    text, n_bytes, fresh = _facts(cfg)
    facts = todo.select("pmcid", F.struct(_rank(fresh).alias("r"), n_bytes.alias("n_bytes"), F.xxhash64(text).alias("_hash"), fresh.alias("status")).alias("_f"))
    return (facts.groupBy("pmcid").agg(F.max("_f").alias("_b"), F.count("*").alias("_n"))
            .select("pmcid", "_b.status", "_b.n_bytes", "_b._hash", "_n"))


def _same_id():
    """The id in columns that are never null: a null id is an id, and join and aggregate share their partitioning."""
    return F.coalesce("pmcid", F.lit("")).alias("_i"), F.col("pmcid").isNull().alias("_z")


#: Rows (an id, a hash and few bytes more) of a table whose measured size allows a broadcast.
FEW = 200_000


def with_texts(chosen: DataFrame, todo: DataFrame, few: bool = False) -> DataFrame:
    """(pmcid, status, n_bytes, content): the texts of the chosen deliveries, of equal ones one.

    Texts move once: a merge join keeps the partitioning that the aggregate after it needs. With ``few``, a
    measured fact, the chosen ones go to the texts instead, and no other text moves."""
    text = F.coalesce(F.col("content"), F.lit(""))
    wanted = chosen.select(*_same_id(), F.col("_hash"), "status", "n_bytes")
    texts = todo.select(*_same_id(), F.xxhash64(text).alias("_hash"), "pmcid", text.alias("content"))
    return (texts.join(wanted.hint("broadcast" if few else "merge"), ["_i", "_z", "_hash"])
            .dropDuplicates(["_i", "_z", "_hash"]).select("pmcid", "status", "n_bytes", "content"))


def all_but(apart: DataFrame, todo: DataFrame, cfg: LandConfig = LandConfig()) -> DataFrame:
    """(pmcid, status, n_bytes, content) of the deliveries of all ids but those of ``apart``, which a count showed to be
    few: no text moves."""
    text, n_bytes, fresh = _facts(cfg)
    rows = todo.select(*_same_id(), "pmcid", fresh.alias("status"), n_bytes.alias("n_bytes"), text.alias("content"))
    return (rows.join(apart.select(*_same_id()).hint("broadcast"), ["_i", "_z"], "left_anti")
            .select("pmcid", "status", "n_bytes", "content"))


def current(landings: DataFrame) -> DataFrame:
    """One row per id of an append-only landing table: its best delivery so far (ok, then restricted, then failed)."""
    rank = F.struct(_rank(F.col("status")).alias("r"), "n_bytes", F.xxhash64("content").alias("h"))
    best = landings.groupBy("pmcid").agg(F.max(rank).alias("_best"), F.count("*").alias("_n"))
    # only ids that landed more than once need a choice; where they are few, no other text moves
    often = kept(best.where("_n > 1").select(*_same_id(), "_best"), "landed-again")
    few = often.count() <= FEW
    rows, often = landings.select("*", *_same_id()), often.hint("broadcast" if few else "merge")
    if few:
        once = rows.join(often, ["_i", "_z"], "left_anti")
        again = rows.join(often, ["_i", "_z"]).where(rank == F.col("_best")).dropDuplicates(["_i", "_z"])
        return once.select(*landings.columns).unionByName(again.select(*landings.columns))
    return (rows.join(often, ["_i", "_z"], "left").where(F.col("_best").isNull() | (rank == F.col("_best")))
            .dropDuplicates(["_i", "_z"]).select(*landings.columns))


def outcome(status_col: str = "status"):
    """restricted counts as failed."""
    s = F.col(status_col)
    return F.when(s == "restricted", "failed").otherwise(s)


def status_counts(statuses: DataFrame) -> DataFrame:
    """(outcome, detail, n) with subtotals per outcome and a grand total
    (ROLLUP: one aggregation, no second pass)."""
    g = statuses.select(outcome().alias("outcome"), F.col("status").alias("detail"))
    r = g.rollup("outcome", "detail").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("outcome", F.lit("total")).alias("outcome"), "detail", "n")
