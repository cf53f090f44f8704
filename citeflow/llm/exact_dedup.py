"""Exact de-duplication against an immutable snapshot with static binary-fuse filters.

Texts become SHA-256 digests of their bytes after lower-casing A-Z. The snapshot's
distinct digests are cut into buckets of bounded size; every bucket gets one static
3-wise binary-fuse filter (about 9 bits a key, 1/256 false positives), written once.
Incoming digests, first grouped among themselves, are screened by the filter of their
bucket: a negative is certainly new, only positives are joined with the snapshot's
exact groups. Rows of every group of two or more are then compared byte by byte with the row that stays.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot_split, join_small_or_shuffle, mixed, stored

#: Distinct digests of a filter bucket.
BUCKET_KEYS = 200_000
#: Rows of a group that meet one copy of the row that stays.
SALT_ROWS = 1000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes after lower-casing A-Z only (null is empty)."""
    return text.encode().translate(_LOWER) if text else b""


# ---------------------------------------------------------------- static binary-fuse filter

class BinaryFuse:
    """Static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        mask = np.uint64(self.segment - 1)
        a = ((h >> np.uint64(32)) * np.uint64(self.segment * self.segments)) >> np.uint64(32)
        b = (a + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        c = (a + np.uint64(2 * self.segment)) ^ (h & mask)
        mark = (h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(51))).astype(np.uint8)
        return np.stack([a, b, c]).astype(np.int64), mark

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(keys)
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for seed in range(1, 200):
            f = cls(seed, segment, segments, np.zeros((segments + 2) * segment, dtype=np.uint8))
            if f._fill(keys):
                return f
        raise RuntimeError("no seed peels this key set")

    def _fill(self, keys: np.ndarray) -> bool:
        places, mark = self._places(keys)
        n, size = len(keys), len(self.table)
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        every = np.tile(np.arange(n), 3)
        np.bitwise_xor.at(owner, places.ravel(), every)
        rounds, left = [], n
        front = np.flatnonzero(count == 1)
        while len(front):
            key, first = np.unique(owner[front], return_index=True)
            slot = front[first]
            rounds.append((key, slot))
            left -= len(key)
            touched = places[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(owner, touched.ravel(), np.tile(key, 3))
            near = np.unique(touched)
            front = near[count[near] == 1]
        if left:
            return False
        for key, slot in reversed(rounds):  # a round's slots are no other place of the round's keys
            self.table[slot] = 0
            self.table[slot] = mark[key] ^ np.bitwise_xor.reduce(self.table[places[:, key]], axis=0)
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, mark = self._places(keys)
        return np.bitwise_xor.reduce(self.table[places], axis=0) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype="<u4").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "BinaryFuse":
        seed, segment, segments = np.frombuffer(blob, dtype="<u4", count=3).tolist()
        return cls(seed, segment, segments, np.frombuffer(blob, dtype=np.uint8, offset=12))


def _keys(digests) -> np.ndarray:
    return np.fromiter((int.from_bytes(d[:8], "little") for d in digests), dtype=np.uint64, count=len(digests))


# ---------------------------------------------------------------- Spark jobs

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of every row's whole normalised text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            out = [hashlib.sha256(normalised(t)).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, digest binary")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): one filter per bucket of the snapshot's distinct digests."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(_keys(list(pdf["digest"])))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "blob": [f.to_bytes()]})

    keyed = groups.select(_bucket(buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").applyInPandas(one, "bucket bigint, blob binary")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("bigint")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Adds ``maybe``: false means the digest is certainly not in the snapshot."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(left), dtype=bool)
        if len(left) and len(right):
            hit = BinaryFuse.from_bytes(right["blob"].iloc[0]).contains(_keys(list(left["digest"])))
        return left.assign(maybe=hit)

    fields = ", ".join(f"{n} {t}" for n, t in groups.dtypes)
    return (groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
            .cogroup(filters.groupBy("bucket"))
            .applyInPandas(one, f"{fields}, bucket bigint, maybe boolean").drop("bucket"))


def _mismatches(docs: DataFrame, members: DataFrame, n_members: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, variant): rows whose bytes differ from those of the row that stays.

    ``members`` are the rows of groups of two or more. A group with very many rows meets
    several copies of its text, one per salt, so no task sees the whole group.
    """
    salts = F.ceil(F.col("group_size") / F.lit(SALT_ROWS)).cast("int")
    ids = members.select(F.col("doc_id").alias("m_id"), "digest", "keep_id", salts.alias("salts")).distinct()
    texts = join_small_or_shuffle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ids,
                                  F.col("doc_id") == F.col("m_id"), "inner", n_members, 64).drop("m_id")
    kind = dict(texts.dtypes)

    def run(batches):
        for b in batches:
            out = pa.array([normalised(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "digest", "keep_id", "salts")] + [out],
                                             ["doc_id", "digest", "keep_id", "salts", "bytes"])

    rows = texts.mapInArrow(run, f"doc_id {kind['doc_id']}, digest binary, keep_id {kind['keep_id']}, salts int, bytes binary")
    # another row of the same id may hold another text: the digest must be the member's own
    rows = rows.where(F.sha2("bytes", 256) == F.lower(F.hex("digest")))
    stays = (rows.where("doc_id = keep_id").groupBy("digest").agg(F.max("salts").alias("s"), F.min("bytes").alias("kept_bytes"))
             .select(F.col("digest").alias("k_digest"), "kept_bytes", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k_salt")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return (rows.join(stays, (F.col("digest") == F.col("k_digest")) & (F.col("salt") == F.col("k_salt")))
            .where("bytes <> kept_bytes").select("doc_id", "digest", F.col("bytes").alias("variant")))


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, id_col: str = "doc_id",
                text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` says which rows are the immutable snapshot (default: half of them, by a
    hash of the id); all others are the incoming batch. The grouping does not depend on it.
    Null texts count as empty and are equal to empty ones. Rows sharing the kept id and text are
    all kept; null ids lose against any other and stay only where the group has no other.
    An empty table gives an empty result; other columns are ignored.
    """
    in_snapshot = in_snapshot if in_snapshot is not None else F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2)) == 0
    rows = stored(digests(docs, id_col, text_col).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "digests")
    snapshot = stored(_groups(rows.where("old")), "snapshot")
    # by the rows of both sides: neither the snapshot's nor the batch's part of a bucket grows with the input
    buckets = 1 + rows.count() // bucket_keys
    filters = stored(build_filters(snapshot, buckets), "filters")
    batch = stored(screen(_groups(rows.where("not old")), filters, buckets), "screened")
    maybe = batch.where("maybe").select(F.col("digest").alias("b_digest"), F.col("keep_id").alias("b_keep"),
                                        F.col("group_size").alias("b_size"))
    on = F.col("digest") == F.col("b_digest")
    joined = (snapshot.join(maybe, on, "left")
              .select("digest", F.greatest("keep_id", "b_keep").alias("keep_id"),
                      (F.col("group_size") + F.coalesce("b_size", F.lit(0))).alias("group_size")))
    false_hits = batch.where("maybe").join(snapshot.select("digest"), "digest", "left_anti")
    new = batch.where("not maybe").unionByName(false_hits).drop("maybe")
    groups = stored(joined.unionByName(new), "groups")
    counts = groups.agg(F.sum("group_size").alias("rows"), F.count("*").alias("groups")).first()
    total = counts["rows"] or 0
    multi = groups.where("group_size > 1")
    n_multi = multi.agg(F.sum("group_size")).first()[0] or 0
    tagged = stored(join_hot_split(rows.drop("old"), multi, "digest", "group_size", total), "tagged")
    odd = stored(_mismatches(docs, tagged.where("group_size > 1"), n_multi, id_col, text_col), "odd")
    n_odd = odd.count()
    result = tagged.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    result = result.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
    if n_odd:  # equal digests, different bytes: group those rows by their bytes instead
        odd = odd.withColumnsRenamed({"doc_id": "o_id", "digest": "o_digest"}).distinct()
        again = (rows.drop("old").join(odd, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("digest") == F.col("o_digest")), "left")
                 .drop("o_id", "o_digest"))
        by = again.groupBy("digest", F.col("variant").alias("g_variant")).agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumnRenamed("digest", "g_digest")
        result = (again.join(by, (F.col("digest") == F.col("g_digest")) & F.col("variant").eqNullSafe(F.col("g_variant")))
                  .drop("g_digest", "g_variant", "variant"))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))
