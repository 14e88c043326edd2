"""Readers and writers: CSV, JSON lines, JSON configuration, folders of files, tables. A missing input is an empty table."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import normalize_text, strip
from lodestone.operators.relational import aligned


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path, with wildcards or not, leads to anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return found is not None and len(found) > 0
    except Py4JError:
        return False


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, trimmed: bool = False) -> DataFrame:
    """CSV with a header, quotes doubled and line ends within quotes; columns by name, missing ones null; rows of blanks
    only are dropped. The types are the schema's, never guessed from the data."""
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=False)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if not raw.columns:
        return spark.createDataFrame([], schema)
    named = raw.toDF(*[c.strip().lstrip("\ufeff") for c in raw.columns])
    cells = named.select(*[(strip(F.col(f"`{c}`")) if trimmed else F.col(f"`{c}`")).alias(c) for c in named.columns])
    some = F.concat_ws("", *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in cells.columns]) != ""
    return aligned(cells.where(some), schema)


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType, required: str, source: str = "source", raw_path: str = "raw_file_path") -> DataFrame:
    """All CSV files of a folder that have the required column, aligned by name; blank sources become ``manual:<file>``.

    Files are found and read by the file system the folder names, each in one task, as line ends may stand within quotes;
    headers may differ from file to file. Empty cells are null and rows of blanks only are dropped.
    """
    if not there(spark, folder):
        return spark.createDataFrame([], schema)
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = csv.reader(io.StringIO(content.decode("utf-8-sig", errors="ignore"), newline=""))
                at = {h.strip(): i for i, h in reversed(list(enumerate(next(lines, []))))}
                if required not in at:
                    continue
                kept = [r for r in lines if any(c.strip() for c in r)]
                cell = lambda r, n: (r[at[n]] or None) if n in at and at[n] < len(r) else None
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), *[pa.array([cell(r, n) for r in kept], pa.string()) for n in names]], names=["__path", *names])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "content")
    read = found.mapInArrow(rows, strings(["__path", *names]))
    name = F.regexp_extract("__path", r"([^/]+)$", 1)
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    filled = read.withColumn(source, F.when(empty(source), F.concat(F.lit("manual:"), name)).otherwise(F.col(source))).withColumn(raw_path, F.when(empty(raw_path), F.col("__path")).otherwise(F.col(raw_path)))
    return aligned(filled, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path) if there(spark, path) else spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if there(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in every part, also when there are no rows."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def publish(df: DataFrame, name: str, persistent: bool = False) -> None:
    """Replaces a table of the session's catalog, or a view over the plan."""
    if persistent:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and normalised ``text`` of text files, one row per file."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    known = F.lower("path").rlike(r"\.(txt|csv|json|jsonl)$")
    return whole.select("path", F.when(known, normalize_text(F.col("value"))).otherwise("").alias("text"))


def scan_folder(spark: SparkSession, path: str, endings: Sequence[str] = (".pdf", ".html", ".htm", ".txt")) -> DataFrame:
    """A manifest of files that were placed by hand: name, ``manual-official://`` url, path and size; contents stay unread."""
    schema = "source string, source_url string, raw_file_path string, bytes long, status string"
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    kept = files.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return kept.select(F.lit("manual_official_papers").alias("source"), F.concat(F.lit("manual-official://"), name).alias("source_url"), F.col("path").alias("raw_file_path"), F.col("length").alias("bytes"), F.lit("downloaded").alias("status"))


def fetch_status(http_status: Column, content_type: Column, head: Column, cached_bytes: Column, allowed: Column, enough: int = 1000) -> Column:
    """Struct ``status``, ``note`` of a file that a collector asked for: kept from before if there is enough of it, skipped where
    not allowed, failed by its answer or its type, else downloaded. ``head`` is the first characters of what came."""
    pdf = F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf") | F.coalesce(head.startswith("%PDF"), F.lit(False))
    told = lambda status, note: F.struct(F.lit(status).alias("status"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    return (
        F.when(F.coalesce(cached_bytes, F.lit(0)) > enough, told("cached", "kept from before"))
        .when(~F.coalesce(allowed, F.lit(False)), told("skipped", "not allowed"))
        .when(http_status.isNull(), told("failed", "no answer"))
        .when(http_status >= 400, told("failed", F.concat(F.lit("HTTP "), http_status.cast("string"))))
        .when(~pdf, told("failed", F.concat(F.lit("not a PDF: "), F.coalesce(content_type, F.lit("")))))
        .otherwise(told("downloaded", ""))
    )


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``unit``, ``chapter``, ``subtopic``, ``keywords`` of a two-level JSON taxonomy; a nested file becomes one row per leaf."""
    schema = "units array<struct<unit:string,chapter:string,subtopics:map<string,array<string>>>>"
    if not there(spark, path):
        return spark.createDataFrame([], "unit string, chapter string, subtopic string, keywords array<string>")
    units = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("units").alias("u"))
    return units.select("u.unit", "u.chapter", F.explode("u.subtopics").alias("subtopic", "keywords"))


def sections_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``section``, ``unit``, ``chapter``, ``subtopic`` of a three-level JSON taxonomy."""
    schema = "sections array<struct<section:string,unit:string,chapters:array<struct<chapter:string,subtopics:array<string>>>>>"
    if not there(spark, path):
        return spark.createDataFrame([], "section string, unit string, chapter string, subtopic string")
    s = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("sections").alias("s"))
    return s.select("s.section", "s.unit", F.explode("s.chapters").alias("c")).select("section", "unit", "c.chapter", F.explode("c.subtopics").alias("subtopic"))


def relevant(url: Column, any_of: Sequence[str], both_of: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """Whether a URL holds one of the terms, or a first term with one of its companions; without regard to case."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    keep = F.lit(False)
    for t in any_of:
        keep = keep | lower.contains(t)
    for first, rest in both_of:
        with_ = F.lit(False)
        for t in rest:
            with_ = with_ | lower.contains(t)
        keep = keep | (lower.contains(first) & with_)
    return keep
