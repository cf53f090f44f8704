"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a fixed shuffled order. A copy of a
document has the virtual finish time (words of its source queued up to and
including it) / (target of its source). Served in the order of that time, all
sources move towards their targets at the same pace and each has received its
target at time 1. The order is cut where the words served would pass the budget.

Running sums never need one source, or the whole order, in one task: shuffle
positions and finish times are cut in ranges, sums per range give the offsets,
and only rows of one range meet in a window. The place of the cut comes down in
three steps (coarse range, fine range, row), so only scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, join_small_or_shuffle, stored

WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a range should hold; ranges, not sources, are what a task sees whole.
RANGE_ROWS = 5000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target, source_rank): shares of the whole size by weight, none above
    ``max_epochs`` times its source's size, the excess shared again by weight.

    Sorted by size/weight the capped sources come first, so one pass of running sums finds the
    common share per unit of weight. The table has one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "source_rank")
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("source_rank", F.row_number().over(by_name))
         .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
         .withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
         .withColumn("need", F.col("most") / F.col("weight")))
    s = (s.withColumn("before", F.coalesce(F.sum("most").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double"))
         .withColumn("pace", (F.col("total") - F.col("before")) / F.col("left"))
         .withColumn("place", F.row_number().over(by_need)))
    # one scalar: the common share per unit of weight (null when every source is capped)
    level = s.where("pace <= need").agg(F.min_by("pace", "place")).first()[0]
    share = F.col("most") if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", "source_rank", share.alias("target"))


def _cut(rows: DataFrame, order: list[str], budget: int, ranges: int, epochs: int):
    """The last served copy as (vft, *order) values, or None when nothing is served.

    ``rows`` has size, queued (inclusive running size in its source), source_size, target.
    """
    copies = (rows.where("size > 0 and target > 0")
              .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
              .withColumn("vft", (F.col("epoch") * F.col("source_size") + F.col("queued")) / F.col("target")))
    served = 0
    part = copies
    for per_unit in (1024, 1024 * ranges):
        sums = (part.groupBy(F.floor(F.col("vft") * per_unit).alias("range"))
                .agg(F.sum("size").alias("words"))
                .withColumn("through", F.sum("words").over(Window.orderBy("range")) + F.lit(served)))
        over = sums.where(F.col("through") > budget).orderBy("range").limit(1).collect()
        if not over:
            break
        served = over[0]["through"] - over[0]["words"]
        part = part.where(F.floor(F.col("vft") * per_unit) == over[0]["range"])
    else:
        inside = part.withColumn("through", F.sum("size").over(Window.orderBy("vft", *order)) + F.lit(served))
        last = inside.where(F.col("through") <= budget).agg(F.max(F.struct("vft", *order)).alias("x")).first()["x"]
        if last is not None:
            return tuple(last)
        # the cut falls before the first copy of the range: everything in earlier ranges is served
        first = part.agg(F.min(F.struct("vft", *order)).alias("x")).first()["x"]
        return ("before", *tuple(first))
    return ("all",)


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, copies, taken.

    Null or empty texts have size 0 and are never taken (their vft would be their
    predecessor's). Rows equal in id, source and text are peers: they get the same finish
    time and are taken or left together, so reruns agree. A null source is a source of
    its own, last in order. An empty table gives an empty result. Other columns are ignored.
    """
    base = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("shuffled")), "mix")
    total = base.agg(F.count("*").alias("rows"), F.sum("size").alias("words")).first()
    ranges = 1 + total["rows"] // RANGE_ROWS
    targets = source_targets(base, weights, max_epochs)
    # position in the shuffled order -> one of `ranges` equal hash ranges
    at = F.floor((F.col("shuffled").cast("double") / F.lit(2.0 ** 64) + 0.5) * ranges)
    base = base.withColumn("slot", at)
    slots = (base.groupBy("source", "slot").agg(F.sum("size").alias("slot_words"))
             .withColumn("offset", F.coalesce(F.sum("slot_words").over(
                 Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumnsRenamed({"source": "s_source", "slot": "s_slot"}).drop("slot_words"))
    t = targets.withColumnRenamed("source", "t_source")
    slots = slots.join(t, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    queue = Window.partitionBy("source", "slot").orderBy("shuffled", "doc_id", "text_hash")
    rows = (base.withColumn("inside", F.sum("size").over(queue))
            .join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slot") == F.col("s_slot")))
            .withColumn("queued", F.col("offset") + F.col("inside"))
            .select("doc_id", "source", "text_hash", "size", "shuffled", "source_size", "source_rank", "target", "queued"))
    rows = stored(rows, "mix")
    order = ["source_rank", "shuffled", "doc_id", "text_hash"]
    cut = _cut(rows, order, total["words"] or 0, ranges, max_epochs)
    copies = F.lit(0)
    for e in range(max_epochs):
        vft = (F.lit(e) * F.col("source_size") + F.col("queued")) / F.col("target")
        if cut[0] == "all":
            taken = F.lit(True)
        else:
            strict = cut[0] == "before"
            values = cut[1:] if strict else cut
            here = F.struct(vft.alias("vft"), *order)
            types = dict(rows.dtypes)
            edge = F.struct(F.lit(values[0]).cast("double").alias("vft"),
                            *[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, values[1:], strict=True)])
            taken = here < edge if strict else here <= edge
        copies = copies + F.when(F.col("target") > 0, F.when(taken, 1).otherwise(0)).otherwise(0)
    return (rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", "taken"))


def apply_mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 42,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, once, or repeated)."""
    p = free_prefix(docs.columns, "mix_")
    plan = (mix(docs, weights, max_epochs, seed, id_col, text_col, source_col).where("copies > 0")
            .groupBy(F.col("doc_id").alias(f"{p}id"), F.col("source").alias(f"{p}source"), F.col("text_hash").alias(f"{p}text"))
            .agg(F.max("copies").alias(f"{p}copies")))
    plan = stored(plan, "mix-plan")
    on = (F.col(id_col).eqNullSafe(F.col(f"{p}id")) & F.col(source_col).eqNullSafe(F.col(f"{p}source"))
          & (F.xxhash64(F.col(text_col)) == F.col(f"{p}text")))
    return (join_small_or_shuffle(docs, plan, on, "inner", plan.count(), 48)
            .withColumn(f"{p}epoch", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies"))))
            .select(*docs.columns))
