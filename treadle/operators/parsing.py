"""Queries that parse the source files themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from treadle.functions.parsers import parse_sources
from treadle.operators.resolution import ROOTED, resolve_calls
from treadle.session import cut, table


def parse_all(spark, d):
    """Chunk rows of every distinct source file."""
    files = table(spark, d, "source_files").where("content is not null").distinct()
    return parse_sources(files)


def parse_summary(spark, d):
    """Chunks, entry points and errors per language and kind."""
    return parse_all(spark, d).groupBy("language", "chunk_type").agg(F.count("*").alias("n"), F.count_if("is_entry_point").alias("n_entry_points"), F.count("error").alias("n_errors"))


def parsed_calls(spark, d):
    """Calls of the parsed files resolved to parsed chunks."""
    n = cut(parse_all(spark, d).where("error is null").select("repo", "id", "name", "file", "language", "start_line", "parent", "package_name", "chunk_type", "imports_map", "calls_with_context").dropDuplicates(["repo", "id"]))
    return resolve_calls(n, table(spark, d, "go_mod"), **ROOTED)


QUERIES = {"parse_all": parse_all, "parse_summary": parse_summary, "parsed_calls": parsed_calls}
SQL: dict[str, str] = {}
