"""Related-paper expansion and ranking (S2): seeds → link edges → scored,
content-filtered, age-weighted, ranked candidates, with summaries.

Plan shape (see ``plans/``):
  edges ⋈ seeds (broadcast when the seed list is checked small)
    → cut-off filter (pushed into the scan) → anti-joins with seeds/exclusions
    → one hash aggregate per candidate (count + ordered seed list)
    → left join with article records (fail-open), one CASE column for the
      ordered reject cascade
    → global scalars (min/max surviving id, max score) as one scalar subquery;
      no cross join, no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfgmod
from ..config import RankConfig
from ..functions.patterns import python_regex
from .util import latest

KEPT = ("kept", "kept_no_metadata")


def dedupe_seeds(seeds: DataFrame) -> DataFrame:
    """One row per seed id, earliest position wins."""
    return seeds.groupBy("seed_id").agg(F.min("ord").alias("ord"))


def limit_seeds(seeds: DataFrame, n: int | None) -> DataFrame:
    """H7: first N seeds by position (None or 0 = all); a bounded top-N."""
    if not n:
        return seeds
    return seeds.orderBy("ord").limit(n)


def candidate_edges(edges: DataFrame, seeds: DataFrame, exclusions: DataFrame,
                    cfg: RankConfig = RankConfig()) -> DataFrame:
    """Surviving (cand_id, seed_id, ord) edges — the long form.

    Filters use the *full* seed list even when the seeds processed are limited
    (D1). This long table is the scale-safe representation of "which seeds
    found which candidate": it never puts one candidate's seeds into one row.
    """
    all_seeds = dedupe_seeds(seeds)
    used = limit_seeds(all_seeds, cfg.max_seeds)  # broadcast or not is left to the statistics
    excl = exclusions.select(F.col("pmid").alias("cand_id")).distinct()
    e = (edges.where(F.col("cand_id") >= F.lit(cfg.min_id))
         .join(used, "seed_id")
         .join(all_seeds.select(F.col("seed_id").alias("cand_id")), "cand_id", "left_anti")
         .join(excl, "cand_id", "left_anti"))
    if cfg.distinct_edges:
        # De-duplicate after the seed and exclusion filters: same result as
        # de-duplicating the whole edge table, on far fewer rows.
        e = e.select("cand_id", "seed_id", "ord").distinct()
    return e


def scores(edges_long: DataFrame) -> DataFrame:
    """F2: (pmid, score) = number of surviving edges; a count with map-side combine, so a hub
    is one pre-reduced row per task."""
    return edges_long.groupBy(F.col("cand_id").alias("pmid")).agg(F.count("*").alias("score"))


def with_seeds(cands: DataFrame, edges_long: DataFrame) -> DataFrame:
    """add ``seeds`` (ARRAY<BIGINT> in seed order) to the given candidates only.

    For the ranked table, which has the list in one cell; its length is bounded by the seed
    list. ``candidate_edges`` is the long form of the same information."""
    own = edges_long.join(cands.select(F.col("pmid").alias("cand_id")), "cand_id", "left_semi")
    lists = own.groupBy(F.col("cand_id").alias("s_pmid")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "seed_id"))).alias("_s"))
    return cands.join(lists, F.col("pmid") == F.col("s_pmid")).select(
        *cands.columns, F.transform("_s", lambda x: x["seed_id"]).alias("seeds"))


def candidate_scores(edges: DataFrame, seeds: DataFrame, exclusions: DataFrame,
                     cfg: RankConfig = RankConfig()) -> DataFrame:
    """q04: (pmid, score, seeds ARRAY<BIGINT> in seed order), in one aggregate.

    score = number of edges from seeds (list length, not distinct, F2)."""
    e = candidate_edges(edges, seeds, exclusions, cfg)
    return e.groupBy("cand_id").agg(
        F.count("*").alias("score"),
        F.array_sort(F.collect_list(F.struct("ord", "seed_id"))).alias("_s"),
    ).select(
        F.col("cand_id").alias("pmid"),
        "score",
        F.transform("_s", lambda x: x["seed_id"]).alias("seeds"),
    )


def seeds_text(col: str = "seeds") -> Column:
    """Seeds joined by commas."""
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ",")


def classify(cands: DataFrame, articles: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """q05/q06 core: add ``comparative`` and ``reason`` (ordered cascade).

    ``articles``: (pmid, title, abstract, pubtypes STRING joined by ';'). A
    candidate without a record is kept unboosted (fail-open, D7), which needs
    an explicit presence marker: absent is not the same as empty. ``cands`` is
    read twice (ids, then rows), so pass a materialised frame for large inputs.
    """
    # Only records of candidates matter: a semi join (a broadcast filter when
    # the candidate ids are small) keeps the corpus text from being shuffled.
    recs = articles.join(cands.select("pmid"), "pmid", "left_semi")
    # Exactly one record per id, whatever was delivered; the last ``ord`` wins.
    recs = latest(recs, "pmid", "ord" if "ord" in articles.columns else None)
    meta = recs.select("pmid", "title", "abstract", "pubtypes", F.lit(True).alias("_has_meta"))
    j = cands.join(meta, "pmid", "left").select(
        *cands.columns, "_has_meta",
        F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")),
                            F.coalesce("abstract", F.lit("")))).alias("_content"),
        F.lower(F.coalesce(F.col("pubtypes"), F.lit(""))).alias("_pubtypes"))
    content = F.col("_content")
    pubtypes = F.col("_pubtypes")

    def rx(pattern: str) -> str:
        return python_regex(f"\\b(?:{pattern})\\b" if cfg.whole_word else pattern)

    has = F.col("_has_meta").isNotNull()
    comp = has & content.rlike(rx(cfg.comparative))
    reason = F.when(~has, "kept_no_metadata")
    if cfg.assembly_only_exclude:
        reason = reason.when(content.rlike(rx(cfg.assembly)) & ~comp, "assembly")
    if cfg.pubtype_strict:
        # D4 strict: exact (case-insensitive) membership of a listed type.
        listed = F.array(*[F.lit(t.lower()) for t in cfg.pubtype.split("|")])
        pt_hit = F.arrays_overlap(F.split(pubtypes, ";"), listed)
    else:
        pt_hit = pubtypes.rlike(rx(cfg.pubtype))
    reason = (reason
              .when((pubtypes != "") & pt_hit, "pubtype")
              .when(content.rlike(rx(cfg.negative)), "negative"))
    if cfg.require_positive:
        reason = reason.when(~content.rlike(rx(cfg.positive)), "no_positive")
    reason = reason.otherwise("kept")
    keep = [c for c in cands.columns]
    return j.select(*keep, comp.alias("comparative"), reason.alias("reason"))


def reject_reasons(classified: DataFrame) -> DataFrame:
    """(reason, candidates)."""
    return classified.groupBy("reason").agg(F.count("*").alias("candidates"))


def filtered(classified: DataFrame) -> DataFrame:
    """Surviving candidates (scores stay as computed before filtering)."""
    return classified.where(F.col("reason").isin(*KEPT))


def run_stats(survivors: DataFrame) -> Column:
    """one scalar subquery (struct) with min/max id, max score, count.

    Evaluated once as a subquery and inlined as a literal, instead of a cross
    join or an unpartitioned window."""
    return survivors.select(F.struct(
        F.min("pmid").alias("min_id"), F.max("pmid").alias("max_id"),
        F.max("score").alias("max_score"), F.count("*").alias("candidates"),
    )).scalar()


def recommended(max_score: Column) -> Column:
    """max(2, max_score // 10)."""
    return F.greatest(F.lit(cfgmod.RECOMMENDED_FLOOR).cast("bigint"),
                      F.floor(max_score / cfgmod.RECOMMENDED_DIVISOR).cast("bigint"))


def with_stats(survivors: DataFrame) -> DataFrame:
    """Attach the run scalars as one struct column ``_st``: the subquery appears
    once in the plan however many expressions read its fields."""
    return survivors.withColumn("_st", run_stats(survivors))


def weighted(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """Age-decayed, boosted score; unrounded (rounding only at output)."""
    s = with_stats(survivors)
    mn, mx = F.col("_st.min_id"), F.col("_st.max_id")
    age = (mx - F.col("pmid")) / (mx - mn)
    decayed = F.when(mx == mn, F.col("score").cast("double")).otherwise(
        F.col("score") * (F.lit(1.0) - F.lit(cfg.beta) * F.pow(age, F.lit(cfg.gamma))))
    w = F.when(F.col("comparative"), decayed * F.lit(cfg.boost)).otherwise(decayed)
    return s.withColumn("weighted", w).drop("_st")


def ranked(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """H1: weighted desc, score desc, id asc (range-partitioned global sort)."""
    return weighted(survivors, cfg).orderBy(F.desc("weighted"), F.desc("score"), F.asc("pmid"))


def score_histogram(survivors: DataFrame, top: int | None = None) -> DataFrame:
    """(score, candidates), score descending; ``top`` keeps the first rows
    (the shell twin prints 20)."""
    h = survivors.groupBy("score").agg(F.count("*").alias("candidates")).orderBy(F.desc("score"))
    return h.limit(top) if top else h


def thresholds(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> Column:
    """I4: distinct {2,3,5,10} ∪ {recommended} as an array (≤ 5 elements);
    reads ``_st`` (see ``with_stats``).

    Only thresholds ≤ max score produce lists; since every score is ≤ the max,
    ``score >= threshold`` below implies it.
    """
    return F.array_distinct(F.array(*[F.lit(t).cast("bigint") for t in cfg.thresholds],
                                    recommended(F.col("_st.max_score"))))


def threshold_lists(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """(threshold, pmid) for score ≥ threshold — the range join is a
    per-row explode over the (≤ 5 element) threshold array, not a join."""
    thr = thresholds(survivors, cfg)
    return (with_stats(survivors).select(F.explode(thr).alias("threshold"), "pmid", "score")
            .where(F.col("score") >= F.col("threshold")).select("threshold", "pmid"))


def threshold_counts(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """(threshold, candidates)."""
    return threshold_lists(survivors, cfg).groupBy("threshold").agg(F.count("*").alias("candidates"))


def confidence_tiers(survivors: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """High (≥ rec), medium (3 ≤ s < rec), low (< 3). Overlapping at
    rec = 2 like the Python twin unless ``cfg.exclusive_tiers``."""
    rec = recommended(F.col("_st.max_score"))
    s = F.col("score")
    high = s >= rec
    med = (s >= cfgmod.MEDIUM_TIER_FLOOR) & (s < rec)
    low = s < cfgmod.MEDIUM_TIER_FLOOR
    if cfg.exclusive_tiers:
        low = low & ~high
    return with_stats(survivors).agg(
        F.first(rec).alias("recommended"),
        F.count_if(high).alias("high"), F.count_if(med).alias("medium"), F.count_if(low).alias("low"))


def run_summary(survivors: DataFrame) -> DataFrame:
    """One row with the run's scalars."""
    return survivors.agg(
        F.count("*").alias("candidates"), F.min("pmid").alias("min_id"),
        F.max("pmid").alias("max_id"), F.max("score").alias("max_score"),
    ).withColumn("recommended", recommended(F.col("max_score")))
