"""Reading of raw CSV files and of split tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets

SEPARATORS = (";", ",", "\t")


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, header``: the first line of every file, found in each file's first block."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"),
    )
    return lines.filter("block = 0").groupBy("path", "length").agg(F.min_by("value", "pos").alias("header"))


def check_headers(headers: DataFrame, required: Mapping[str, Sequence[str]], category: str, min_bytes: int) -> DataFrame:
    """Add ``problem``: too small, no semicolon, or required columns missing; NULL when fine."""
    tidy = F.transform(F.split(F.lower("header"), ";"), lambda c: F.btrim(F.trim(c), F.lit('"')))
    wanted = F.array(*[F.lit(c) for c in required[category]])
    missing = F.array_except(wanted, tidy)
    problem = (
        F.when(F.col("length") < min_bytes, F.lit("too small"))
        .when(~F.contains(F.col("header"), F.lit(";")), F.lit("no ';' in header"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    )
    return headers.withColumn("problem", problem)


def profiles(spark: SparkSession, path: str) -> list[tuple[str, bool, list[str]]]:
    """``(header, valid UTF-8, files)`` for each kind of file below ``path``, judged over whole files.

    The driver gets file names, as it does for any listing.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    files = lines.groupBy("path").agg(
        F.min_by("value", F.struct("block", "pos")).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    kinds = files.groupBy(F.hex(F.col("header").cast("binary")).alias("header"), "utf8").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [
        (bytes.fromhex(r["header"]).decode("utf-8" if r["utf8"] else "iso-8859-1").removeprefix("\ufeff"), r["utf8"], r["paths"])
        for r in kinds.orderBy(F.col("paths")[0]).collect()
    ]


def _literal(uri: str) -> str:
    """A file's address as a path that is not taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """CSV files whose separator and encoding may differ; text columns unless a schema is given, no inference pass.

    A file is ISO-8859-1 if any of its lines is not UTF-8, and has the first separator that its header holds. Files are read by
    their own headers and joined by column name; columns that a file lacks are NULL. None if no file has two columns;
    some with and some without are an error, since rows would be lost.
    """
    kinds = profiles(spark, path)
    found = [(next((s for s in SEPARATORS if s in header), None), utf8, files) for header, utf8, files in kinds]
    if all(sep is None for sep, _, _ in found):
        return None
    if odd := [f for sep, _, files in found for f in files if sep is None]:
        raise ValueError(f"no separator in {', '.join(odd)}")
    types = {f.name: f.dataType for f in schema or ()}
    parts = []
    for sep, utf8, files in found:
        reader = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("sep", sep)
        reader = reader.option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        paths = [_literal(f) for f in files]
        names = reader.csv(paths[0]).columns
        own = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        part = reader.schema(own).csv(paths)
        parts.append(part.select(*[n for n in names if n in types]) if schema else part)
    out = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    if schema:
        out = out.select(*[F.col(n) if n in out.columns else F.lit(None).cast(k).alias(n) for n, k in types.items()])
    return out


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One side of a split table; the partition filter prunes the other side's files."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_first_available(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first path of a priority list that exists."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def schema_of(table: str) -> T.StructType:
    """Declared types of a raw table as a reader schema."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(c, kinds[k]) for c, (k, _) in presets.TABLE_SCHEMAS[table].items()])
