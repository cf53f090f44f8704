"""Token-ID output: sharded wavelet-matrix files in ascending document order, and their reader.

Documents are range-partitioned and sorted by id; every task encodes its rows, appends the
end id to each and closes a shard whenever it holds SHARD_TOKENS, so memory is bounded by a shard (or
the longest document). A shard is one row of a Parquet table in a folder that all executors share:
(part, seq, n_tokens, doc_ids, blob), ``blob`` being the file of ``wavelet.py``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wavelet import Wavelet, build
from .words import WordIds

#: Tokens of a shard.
SHARD_TOKENS = 1 << 19


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of every whole text, with ``end_id`` after each, in ascending order of the id.

    Null texts are empty (the end id alone). Null ids come first; rows of equal id are ordered by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        coder, part, seq = WordIds.of(tokenizer), TaskContext.get().partitionId(), 0
        names, lengths, ids, size = [], [], [], 0
        id_type = None

        def close():
            blob = build(np.concatenate(ids), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([names], pa.list_(id_type)), pa.array([blob], pa.binary())],
                ["part", "seq", "n_tokens", "doc_ids", "blob"])

        for b in batches:
            id_type = b.column(0).type
            for i in range(0, b.num_rows, 200):
                slab = b.slice(i, 200)
                flat, offsets = coder.texts(slab.column(1).to_pylist())
                flat = np.insert(flat, offsets[1:], end_id)
                own = np.diff(offsets) + 1
                names += slab.column(0).to_pylist()
                ids.append(flat.astype(np.uint32))
                lengths.append(own)
                size += len(flat)
                if size >= shard_tokens:
                    yield close()
                    names, lengths, ids, size, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    rows.mapInArrow(run, f"part int, seq int, n_tokens bigint, doc_ids array<{kind}>, blob binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens before it), n_tokens, ids_crc32.

    Offsets are running sums over one row per shard, in two steps, by part and inside a part.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = shards.select(F.col("part").alias("s_part"), F.col("seq").alias("s_seq"), "n_tokens")
    before = Window.partitionBy("s_part").orderBy("s_seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes.groupBy(F.col("s_part").alias("p_part")).agg(F.sum("n_tokens").alias("t"))
             .withColumn("p_start", F.coalesce(F.sum("t").over(
                 Window.orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    starts = (sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
              .join(parts, F.col("s_part") == F.col("p_part"))
              .select("s_part", "s_seq", (F.col("p_start") + F.col("inside")).alias("shard_start")))

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                own = b.slice(row, 1)
                file = Wavelet(own.column("blob")[0].as_py())
                ids, ends = file.all().astype("<u4"), np.cumsum(file.lengths, dtype=np.int64)
                first = ends - file.lengths
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(first.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, own.column("part")[0].as_py()), pa.int32()),
                     pa.array(np.full(n, own.column("seq")[0].as_py()), pa.int32()),
                     own.column("doc_ids").flatten(),
                     pa.array(first, pa.int64()), pa.array(file.lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = shards.select("part", "seq", "doc_ids", "blob").mapInArrow(
        run, f"part int, seq int, doc_id {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return (read.join(starts, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq")))
            .select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
