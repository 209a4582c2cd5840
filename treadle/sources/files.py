"""File trees as source rows, and the readers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions import text
from treadle.session import ship


def scan_tree(spark: SparkSession, root: str, repo: str, known_only: bool = True) -> DataFrame:
    """``(repo, path, content)`` below ``root``: ignored directories, unknown extensions, large and undecodable files are left out.

    Paths are filtered before a file's content is read.
    """
    ship(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    f = f.withColumn("path", path).where(~text.is_ignored(F.col("path")) & (F.col("length") <= text.MAX_FILE_BYTES))
    if known_only:
        f = f.where(text.language_of(F.col("path")).isNotNull())
    return f.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.lit(repo).alias("repo"), "path", F.decode("content", "UTF-8").alias("content"))


def go_module(files: DataFrame) -> DataFrame:
    """``(repo, module)`` from the go.mod files of a scan."""
    m = files.where("path = 'go.mod'").select("repo", F.nullif(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), F.lit("")).alias("module"))
    return m
