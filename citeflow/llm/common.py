"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Texts are handed to numpy in groups of about this many bytes.
CHUNK_BYTES = 1 << 18

#: Bytes of rows that go to a Python worker at a time where the session sets nothing. Every task holds such a batch several
#: times over outside the heap (vectors and socket buffers, which double as they grow); Spark's own bound is 64 MB. Buffers of
#: a MB or two come out of the allocator's pool, larger ones are allocated one by one and leave gaps that stay with the process.
ARROW_BYTES, ARROW_SETTING = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xBF58476D1CE4E5B9)
_MULT2 = np.uint64(0x94D049BB133111EB)


def ship_code(spark: SparkSession) -> None:
    """Hand this package's modules to the Python workers through Spark itself, once per
    application, so that no worker depends on the driver's folders; their batches are bounded to ``ARROW_BYTES``."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="citeflow-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED["app"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(columns: list[str], base: str) -> str:
    """``base``, lengthened until no given column begins with it."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base = "_" + base
    return base


def spread_tasks(df: DataFrame) -> DataFrame:
    """At least as many tasks as cores for CPU-heavy work on a small input; an
    input that already arrives in more splits is returned as it is."""
    ship_code(df.sparkSession)
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed
    once, lineage cut, columns still prunable by every later reader."""
    ship_code(df.sparkSession)
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_part(spark: SparkSession, schema, path: str) -> DataFrame:
    """One folder of a table written with ``partitionBy``, empty where no row fell into it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` after their last reader has run, and let Spark's cleaner take away the shuffle
    files of jobs whose frames are gone. Nothing may depend on the tables any more but other stored tables."""
    for table in tables:
        session = table.sparkSession
        jvm, conf = session.sparkContext._jvm, session.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def join_small_or_shuffle(left: DataFrame, right: DataFrame, on, how: str, rows: int,
                          row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast ``right`` only when its measured ``rows`` prove it small."""
    return left.join(F.broadcast(right) if rows * row_bytes <= max_bytes else right, on, how)


def join_hot_split(left: DataFrame, right: DataFrame, key: str, size_col: str, total: int,
                   how: str = "left") -> DataFrame:
    """Join (left or inner) of rows with their group's row where one group may hold a third of all rows.

    ``right`` has one row per ``key`` and the number of left rows of it in ``size_col``. Groups of
    at least total/1000 rows number at most 1000, so that part of ``right`` is a broadcast of
    proven size; only rows of smaller groups meet theirs by a shuffle on the key.
    """
    limit = max(1, total // 1000)
    others = [c for c in right.columns if c != key]
    hot, cold = (part.select([F.col(c).alias(f"{name}_{c}") for c in right.columns]) for name, part in (
        ("hot", right.where(F.col(size_col) > limit)), ("cold", right.where(F.col(size_col) <= limit))))
    # rows that need no lookup, or had theirs, are spread by their own hash, which meets no key
    spread = F.xxhash64(*left.columns)
    if left.schema[key].dataType.typeName() == "binary":
        spread = spread.cast("string").cast("binary")
    marked = left.join(F.broadcast(hot), F.col(key) == F.col(f"hot_{key}"), "left")
    at = F.when(F.col(f"hot_{key}").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread)
    out = (marked.withColumn("cold_at", at).join(cold, F.col("cold_at") == F.col(f"cold_{key}"), "left")
           .select(*left.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in others]))
    return out.where(F.col(size_col).isNotNull()) if how == "inner" else out


# ---------------------------------------------------------------- words and shingles in numpy

def byte_tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(A-Z to a-z, "is part of a word") over the 256 byte values. Separators are
    ASCII, so cutting the UTF-8 bytes cuts between whole characters."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    return lower, word


#: Separators of the word rule ``[^\\x20\\x09-\\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER, SPACE_WORD = byte_tables(SPACES)


def text_slices(column, limit: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """An Arrow text column as lists of about ``limit`` bytes, one text at least; null is empty. Only
    one list is held as Python strings."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of an Arrow column, as ``text_slices``."""
    at = 0
    for texts in text_slices(column, limit):
        yield at, [t.encode() for t in texts]
        at += len(texts)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), element-wise."""
    h = (h ^ (h >> np.uint64(30))) * _MULT
    h = (h ^ (h >> np.uint64(27))) * _MULT2
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        m = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("p", _BASE), ("q", inverse)):
            row = np.full(m, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["p"], _POWERS["q"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the bytes of every non-empty span, from running sums."""
    p, q = _powers(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64)
    low = np.where(start > 0, total[start - 1], np.uint64(0))
    return mixed((total[end - 1] - low) * q[start] + (end - start).astype(np.uint64) * _MULT)


def word_places(texts: list[bytes], word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, ...]:
    """The texts joined by a blank (A-Z lower-cased), (first byte, end byte) of every word of them, and
    the array ``first`` with text i owning words first[i]:first[i+1]."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    inside = word[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    return data, start, end, first


def word_spans(texts: list[bytes], word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, ...]:
    """``word_places`` with the words' hashes instead of the bytes."""
    data, start, end, first = word_places(texts, word)
    return span_hashes(data, start, end), start, end, first


def word_hashes(texts: list[bytes], word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, in order, and where each text's words begin."""
    hashes, _, _, first = word_spans(texts, word)
    return hashes, first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _BASE + words[j: n + j]
    return mixed(acc)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer
    words the whole sequence as one; without words an empty array."""
    words, first = word_hashes(texts)
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a: b - k + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a)
        else:
            yield np.empty(0, dtype=np.uint64)


# ---------------------------------------------------------------- connected components

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component = smallest node reachable.

    Alternating large-star / small-star rounds (each a group-min and a join, all
    distributed); the number of rounds grows with the logarithm of the component
    size. A hub's neighbours are never gathered: every step is a fixed-width
    ``min`` aggregate with map-side combine. Each round is stored in the shared folder.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())

    e = stored(canonical(edges), "cc")
    before = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of a node points at the node's smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.distinct()
        # small-star: a node and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*")
        e = stored(canonical(small), "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component") \
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


