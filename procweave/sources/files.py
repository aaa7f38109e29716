"""File sources: procedure files, exported DDL trees, Markdown with Mermaid (S1, S2, S16, K15 input).

One ``wholetext`` scan per directory tree: every file becomes one row, the
file path comes from the hidden ``_metadata`` column, and object kind,
schema and name are cut out of the path with string functions. A million
files are a million rows spread over tasks, not a Python loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions import constants as K
from procweave.functions.extract import strip_ws


def _scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # wholetext must be passed as an argument: as an option the reader still splits lines
    return reader.text(path, wholetext=True).select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"))


def load_procedures(spark: SparkSession, path: str, extension: str = "prc") -> DataFrame:
    """``procedures(name, source_code, file_path)`` from ``*.<extension>`` files under ``path``.

    Text is stripped, empty files are skipped, the key is the upper-case
    file stem; when a stem appears twice the last file (by path) wins, as a
    dict overwrite would. Raises when no file matches.
    """
    files = _scan(spark, path, f"*.{extension.lstrip('.')}")
    stem = F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")
    df = (files.select(F.upper(stem).alias("name"), strip_ws("content").alias("source_code"), "file_path")
          .filter(F.col("source_code") != ""))
    last = df.groupBy("name").agg(F.max_by(F.struct("source_code", "file_path"), "file_path").alias("r"))
    out = last.select("name", "r.source_code", "r.file_path")
    if out.limit(1).count() == 0:
        raise FileNotFoundError(f"no *.{extension} file with code under {path}")
    return out


def find_procedure(procs: DataFrame, name: str) -> DataFrame:
    """One procedure by exact key, else by case-insensitive stem."""
    exact = procs.filter(F.col("name") == name)
    return exact.unionByName(procs.filter(F.upper("name") == name.upper()).join(exact.select("name"), "name", "left_anti")) \
        .orderBy(F.when(F.col("name") == name, 0).otherwise(1)).limit(1)


def read_ddl_tree(spark: SparkSession, output_dir: str, schema: str | None = None) -> DataFrame:
    """``objects(schema, obj_type, name, ddl)`` from ``<dir>/<schema>/<kind>/<name>.<ext>``.

    Nine kinds; procedures read ``.prc``, functions ``.fnc``, the rest
    ``.sql``; the name is the file stem with its case kept. All schemas are
    read in one scan unless ``schema`` is given.
    """
    root = output_dir.rstrip("/") + (f"/{schema}" if schema else "")
    files = _scan(spark, root)
    kinds = "|".join(K.OBJECT_KINDS)
    parts = F.regexp_extract("file_path", rf"/([^/]+)/({kinds})/([^/]+)\.([A-Za-z0-9]+)$", 0)
    df = files.select(
        F.regexp_extract("file_path", rf"/([^/]+)/({kinds})/[^/]+$", 1).alias("schema"),
        F.regexp_extract("file_path", rf"/({kinds})/[^/]+$", 1).alias("obj_type"),
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("name"),
        F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).alias("ext"),
        F.col("content").alias("ddl"), parts.alias("_m"))
    ext_ok = (F.when(F.col("obj_type") == "procedures", F.col("ext") == K.KIND_EXTENSION["procedures"])
              .when(F.col("obj_type") == "functions", F.col("ext") == K.KIND_EXTENSION["functions"])
              .otherwise(F.col("ext") == K.DEFAULT_EXTENSION))
    out = df.filter((F.col("_m") != "") & ext_ok)
    if schema:
        out = out.withColumn("schema", F.lit(schema))
    return out.select("schema", "obj_type", "name", "ddl")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files (``*.md``) under ``path`` as ``(file_path, content)``."""
    return _scan(spark, path, "*.md").select("file_path", "content")
