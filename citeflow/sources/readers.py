"""Scans A1-A10 with explicit schemas (no inference on any production path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .files import discovered, file_bytes, is_folder, open_storage

# PubMed-style article record. Title is a plain STRING so inline markup such as
# <i>…</i> stays inside the title text instead of being split off (schema
# inference would turn mixed content into a struct).
ARTICLE_SCHEMA = T.StructType([
    T.StructField("MedlineCitation", T.StructType([
        T.StructField("PMID", T.StringType()),
        T.StructField("Article", T.StructType([
            T.StructField("ArticleTitle", T.StringType()),
            T.StructField("Abstract", T.StructType([
                T.StructField("AbstractText", T.ArrayType(T.StringType())),
            ])),
            T.StructField("PublicationTypeList", T.StructType([
                T.StructField("PublicationType", T.ArrayType(T.StringType())),
            ])),
        ])),
    ])),
])

CROSSWALK_SCHEMA = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("pmcid", T.StringType()),
])


def corpus(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """A1: recursive whole-file scan → (path, text). Case-sensitive glob, any depth.

    Each file is one row (whole-text mode), so a file is never split across tasks;
    many files spread over many tasks. Unreadable files are skipped.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of small text files (dictionaries): (path, line_no, value).

    Line numbers need the file as a unit, so this reads whole files; it is meant
    for configuration-sized inputs only.
    """
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"),
                F.posexplode(F.split(F.col("value"), "\n")).alias("pos", "value"))
        .select("path", (F.col("pos") + 1).alias("line_no"),
                F.regexp_replace("value", "\r$", "").alias("value"))
    )


def id_list(spark: SparkSession, path: str, header: bool = False, skip: int = 0) -> DataFrame:
    """A3: ids from a plain list or a ranked TSV: first tab field, CR stripped,
    empties dropped. ``header`` or a number of leading lines to ``skip`` per file must be
    explicit (no silent default, trap T12). ``skip`` reads each file as a unit."""
    if skip:
        return tx.parse_id_lines(text_lines(spark, path), "value", header_lines=skip, line_no="line_no")
    raw = (
        spark.read.schema("value string").option("sep", "\t").option("header", header)
        .option("mode", "PERMISSIVE").csv(path)
    )
    return tx.parse_id_lines(raw, "value", header_lines=0)


def edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: link edges (seed_id, cand_id). Raw id text is cleaned with C1."""
    df = spark.read.format(fmt).load(path)
    if "value" in df.columns:
        df = df.select("seed_id", tx.clean_id(F.col("value")).alias("cand_id")).where(
            F.col("cand_id").isNotNull())
    return df.select(F.col("seed_id").cast("bigint"), F.col("cand_id").cast("bigint"))


def edge_rejects(raw: DataFrame) -> DataFrame:
    """Raw edge lines that are not blank but do not clean to a digit id,
    counted (the original drops them; here they are reported)."""
    v = F.regexp_replace(F.col("value").cast("string"), r"(?U)^\s+|\s+$", "")
    bad = (v != "") & tx.clean_id(F.col("value")).isNull()
    return raw.agg(F.count_if(bad).alias("rejected"), F.count("*").alias("lines"))


def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """A5: PubMed XML files → one row per PubmedArticle (row tag), explicit schema."""
    raw = (
        spark.read.format("xml").option("rowTag", "PubmedArticle")
        .schema(ARTICLE_SCHEMA).load(path)
    )
    return flatten_article(raw)


def flatten_article(df: DataFrame, col: str | None = None, keep=()) -> DataFrame:
    """Record → (pmid, title, abstract, pubtypes, pubtypes_joined,
    n_sections), plus the ``keep`` columns."""
    mc = F.col(col).getField("MedlineCitation") if col else F.col("MedlineCitation")
    art = mc.getField("Article")
    sections = art.getField("Abstract").getField("AbstractText")
    types = art.getField("PublicationTypeList").getField("PublicationType")
    return df.select(
        *keep,
        tx.clean_id(mc.getField("PMID")).alias("pmid"),
        F.coalesce(tx.strip_tags(art.getField("ArticleTitle")), F.lit("")).alias("title"),
        F.coalesce(F.array_join(F.transform(sections, tx.strip_tags), " "), F.lit("")).alias("abstract"),
        F.coalesce(types, F.array().cast("array<string>")).alias("pubtypes"),
        F.coalesce(F.array_join(types, ";"), F.lit("")).alias("pubtypes_joined"),
        F.when(sections.isNotNull(), F.size(sections)).otherwise(F.lit(0)).alias("n_sections"),
    )


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column TSV pmid, pmcid."""
    return spark.read.schema(CROSSWALK_SCHEMA).option("sep", "\t").csv(path)


#: Extension filter of the raw documents, applied while listing (any case).
RAW_GLOB = "*.{[xX][mM][lL],[hH][tT][mM],[hH][tT][mM][lL]}"


def missing_paths(spark: SparkSession, paths: list) -> list:
    """The given files that do not exist (asked of the paths' own file systems)."""
    sc = spark.sparkContext
    conf, path = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]


def _raw_name(name: str) -> bool:
    """RAW_GLOB, and the names that Spark's readers leave out."""
    return _entered(name) and name.lower().endswith((".xml", ".htm", ".html"))


def _entered(name: str) -> bool:
    """Whether Spark's readers list a file or folder of this name."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def _files_below(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, length, content) of the raw documents below a folder, listed and read by tasks, paths written as Spark's
    readers write them; None for what only Spark's readers open: a pattern, a single file, another store."""
    if any(c in root for c in "{}[]*?\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    uri = path.toUri()
    place = uri.getPath() if uri.getScheme() == "file" else uri.toASCIIString()
    if not is_folder(place):
        return None
    top = open_storage(place)[1].rstrip("/")
    name = F.concat(F.lit(path.toString().rstrip("/")), F.substring("place", len(top) + 1, 1 << 30))
    files = file_bytes(discovered(spark, place, _raw_name, _entered), place)
    return files.select(name.alias("path"), F.col("size").alias("length"), "content")


RANKED_SCHEMA = "PMID bigint, Score bigint, WeightedScore string, Seeds string"


def ranked_table(spark: SparkSession, path: str) -> DataFrame:
    """The ranked table (B1) read back with its fixed columns."""
    return spark.read.schema(RANKED_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def threshold_lists(spark: SparkSession, path: str) -> DataFrame:
    """The id lists per threshold (B2): (threshold, pmid)."""
    return spark.read.schema("value string, threshold bigint").text(path).select(
        "threshold", tx.clean_id(F.col("value")).alias("pmid"))


def curated_ids(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """A curated id table (seeds or exclusions), one id a line: (id, ord) in file order;
    blank lines and lines starting with ``#`` are left out."""
    lines = text_lines(spark, path).where(F.col("line_no") > skip)
    v = tx.py_strip(F.col("value"))
    return lines.where((v != "") & ~v.startswith("#")).select(tx.clean_id(v).alias("id"), F.col("line_no").alias("ord"))


def raw_documents(spark: SparkSession, root: str | list) -> DataFrame:
    """.xml/.html/.htm files (case-insensitive, recursive) or an explicit list.

    (path, src_bytes, content, status): a listed file that does not exist is a row with status
    ``missing`` and null content, and bytes that are not UTF-8 become U+FFFD (status
    ``repaired``) instead of ending the job; all others are ``ok``. A folder is listed and read by tasks; the driver holds
    the names of all files for a list, a pattern and a store that only Spark's readers open."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", RAW_GLOB)
    gone: list = []
    if isinstance(root, (list, tuple)):
        gone = missing_paths(spark, list(root))
        there = [p for p in root if p not in set(gone)]
        df = reader.load(there) if there else None
    else:
        df = _files_below(spark, root)
        if df is None:
            df = reader.option("recursiveFileLookup", True).load(root)
    lost = spark.createDataFrame([(p, None, None, "missing") for p in gone],
                                 "path string, src_bytes bigint, content string, status string")
    if df is None:
        return lost
    raw = F.col("content").cast("string")
    found = df.select("path", F.col("length").alias("src_bytes"), F.make_valid_utf8(raw).alias("content"),
                      F.when(F.is_valid_utf8(raw), "ok").otherwise("repaired").alias("status"))
    return found.unionByName(lost) if gone else found


def extraction_tsv(spark: SparkSession, path: str, columns) -> DataFrame:
    """A10: extraction table in a known layout; quoted cells, stray CR trimmed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = (
        spark.read.schema(schema).option("sep", "\t").option("quote", '"')
        .option("header", True).option("enforceSchema", True).csv(path)
    )
    return df.select([F.regexp_replace(F.col(f"`{c}`"), "\r$", "").alias(c) for c in columns])
