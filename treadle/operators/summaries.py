"""Summaries from chunks to files, flows, packages and repositories, and answers from them.

A model is a function over batches of prompts (``MODELS``); offline it is an
extractive stub, the first sentences of what it is given. Prompts are text
columns. A chunk whose stored hash is unchanged is not summarised again, and a
failing call is tried ``RETRIES`` times and then leaves the summary null instead
of losing the row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions import text
from treadle.operators.graph import budgeted_expansion, detect_flows, edges, file_inbound_outbound, linked, nodes, ranked
from treadle.session import cut, table

RETRIES, CODE_CHARS, FLOW_CHARS, RENDERED = 3, 1500, 200, 30

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def extractive(prompts: list[str]) -> list[str]:
    """The first two sentences after the last ``Text:``."""
    out = []
    for p in prompts:
        body = (p or "").rpartition("Text:\n")[2].strip()
        out.append(" ".join(re.split(r"(?<=[.!?])\s+", body)[:2])[:300])
    return out


MODELS = {"extractive": extractive}


def summarise(df: DataFrame, prompt: str, out: str = "summary", model: str = "extractive") -> DataFrame:
    """Adds the model's reply to each prompt; concurrency is the number of partitions."""
    call = MODELS[model]

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            for attempt in range(RETRIES):
                try:
                    yield pd.Series(call(b.tolist()))
                    break
                except Exception:  # noqa: BLE001
                    if attempt == RETRIES - 1:
                        yield pd.Series([None] * len(b))

    return df.withColumn(out, reply(prompt))


def _names(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(out))


def or_none(c):
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))


def told(spark: SparkSession, d: str, *cols) -> DataFrame:
    """Chunks with the digest of their code and what a prompt shows of them; the code itself is not shuffled."""
    body = F.coalesce(F.nullif("docstring", F.lit("")), F.substring("code", 1, CODE_CHARS)).alias("body")
    return nodes(spark, d, "name", "chunk_type", text.content_hash(F.col("code")).alias("digest"), body, *cols)


def chunk_summaries(n: DataFrame, calls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(repo, id, digest, summary)`` of chunks ``told`` that are no modules; those in ``known(repo, id, digest)`` are skipped."""
    c = n.where("chunk_type <> 'module'")
    if known is not None:
        c = c.join(known, ["repo", "id", "digest"], "left_anti")
    label = n.select("repo", "id", "name")
    into = ranked(calls.select("repo", F.col("dst").alias("id"), F.col("src").alias("other")), ["repo", "id"], ["other"], 6)
    out = ranked(calls.select("repo", F.col("src").alias("id"), F.col("dst").alias("other")), ["repo", "id"], ["other"], 6)
    named = lambda x, col: _names(x.join(label.withColumnRenamed("id", "other"), ["repo", "other"]), ["repo", "id"], "name", col)
    j = c.join(named(into, "callers"), ["repo", "id"], "left").join(named(out, "callees"), ["repo", "id"], "left")
    prompt = F.concat_ws("\n", F.concat(F.lit("Describe "), "chunk_type", F.lit(" "), "name"), F.concat(F.lit("Callers: "), or_none("callers")), F.concat(F.lit("Callees: "), or_none("callees")), F.lit("Text:"), F.col("body"))
    return summarise(j.withColumn("prompt", prompt), "prompt").select("repo", "id", "digest", "summary")


def file_summaries(n: DataFrame, chunks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``(repo, file, summary)``; ``links(repo, direction, file, other)`` names the files that a file calls and is called by."""
    j = n.where("chunk_type <> 'module' and file is not null").join(chunks, ["repo", "id"], "left")
    line = F.struct("start_line", "id", F.concat_ws(": ", "name", F.nullif("summary", F.lit(""))).alias("line"))
    g = j.groupBy("repo", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))
    if links is None:
        return summarise(g.withColumn("prompt", F.concat(F.lit("File "), "file", F.lit("\nText:\n"), "body")), "prompt").select("repo", "file", "summary")
    by = lambda way: F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == way, F.col("other")))), ", ").alias(way)
    g = g.join(links.groupBy("repo", "file").agg(by("in"), by("out")), ["repo", "file"], "left")
    prompt = F.concat(F.lit("File "), "file", F.lit("\nCalled by: "), or_none("in"), F.lit("\nCalls: "), or_none("out"), F.lit("\nText:\n"), "body")
    return summarise(g.withColumn("prompt", prompt), "prompt").select("repo", "file", "in", "out", "summary")


@query
def chunk_context_summaries(spark, d):
    return chunk_summaries(told(spark, d), edges(spark, d, "CALLS"))


@query
def linked_file_summaries(spark, d):
    """Files with the files they call and are called by, ten of each at most."""
    n = told(spark, d, "file", "start_line")
    return file_summaries(n, chunk_summaries(n, edges(spark, d, "CALLS")), file_inbound_outbound(spark, d))


@query
def package_summaries(spark, d):
    """Packages with their file summaries, dependencies and the stub's reply."""
    n = told(spark, d, "file", "start_line", "package_name")
    files = file_summaries(n, chunk_summaries(n, edges(spark, d, "CALLS")))
    own = n.where("package_name <> '' and chunk_type <> 'module'").select("repo", "package_name", "file").distinct().join(files, ["repo", "file"]).where("summary <> ''")
    g = own.groupBy("repo", "package_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "summary"))), lambda x: x["summary"]), "\n").alias("body"), F.count("*").alias("n_files"))
    needs = _names(linked(spark, d, "package_name"), ["repo", "a"], "b", "depends_on").withColumnRenamed("a", "package_name")
    g = g.join(needs, ["repo", "package_name"], "left").withColumn("prompt", F.concat(F.lit("Package "), "package_name", F.lit("\nDepends on: "), or_none("depends_on"), F.lit("\nText:\n"), "body"))
    return summarise(g, "prompt").select("repo", "package_name", "n_files", "depends_on", "summary")


@query
def flow_summaries(spark, d):
    n = nodes(spark, d, "name", "is_entry_point", "entry_point_type", "entry_point_route", "signature")
    f = detect_flows(n, edges(spark, d, "CALLS")).join(n, ["repo", "id"])
    g = f.groupBy("repo", "entry").agg(F.max(F.when(F.col("step") == 1, text.flow_name(F.col("entry_point_type"), F.col("entry_point_route"), F.col("name")))).alias("flow"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "name", "signature"))), lambda x: F.concat_ws(" ", x["step"].cast("string"), x["name"], x["signature"])), "\n").alias("body"))
    return summarise(g.withColumn("prompt", F.concat(F.lit("Flow "), "flow", F.lit("\nText:\n"), "body")), "prompt").select("repo", "entry", "flow", F.substring("summary", 1, FLOW_CHARS).alias("summary"))


LISTED_PACKAGES, LISTED_ENTRIES, LISTED_OUTSIDE = 10, 20, 20


@query
def codebase_summary(spark, d):
    """Languages, entry points, packages and outside packages of each repository; every list is bounded before it is collected."""
    n = nodes(spark, d, "language", "chunk_type", "is_entry_point", "package_name", "name")

    def first(df: DataFrame, col: str, limit: int, name: str) -> DataFrame:
        return _names(ranked(df.select("repo", col).distinct(), ["repo"], [col], limit), ["repo"], col, name)

    g = n.groupBy("repo").agg(F.count_if("is_entry_point").alias("n_entry_points"))
    for part in (
        first(n.where("chunk_type <> 'module' and language <> ''"), "language", 100, "languages"), first(n.where("package_name <> ''"), "package_name", LISTED_PACKAGES, "packages"),
        first(n.where("is_entry_point"), "name", LISTED_ENTRIES, "entries"), first(tech_stack(spark, d), "from_path", LISTED_OUTSIDE, "outside"),
    ):
        g = g.join(part, "repo", "left")
    said = F.concat(F.lit("\nText:\nWritten in "), or_none("languages"), F.lit(". Packages: "), or_none("packages"), F.lit(". Entry points: "), or_none("entries"), F.lit(". Uses: "), or_none("outside"), F.lit("."))
    return summarise(g.withColumn("prompt", F.concat(F.lit("Repository "), "repo", said)), "prompt").select("repo", "languages", "n_entry_points", "packages", "entries", "outside", "summary")


def answer(questions: DataFrame, seeds: DataFrame, n: DataFrame, e: DataFrame, codes: DataFrame, budget: int = 4000) -> DataFrame:
    """``(query_id, prompt)``: seeds without tests unless asked for, expanded under the budget, rendered in order.

    ``questions(query_id, question)``, ``seeds(query_id, repo, id, at)``; a query
    whose expansion is empty is rendered from its seeds. ``n`` has the ``size`` of
    each chunk in tokens; only what is rendered is joined with ``codes(repo, id, code)``.
    """
    asked = seeds.join(questions.select("query_id", text.asks_for_tests(F.col("question")).alias("tests")), "query_id")
    kept = asked.join(n.select("repo", "id", "is_test"), ["repo", "id"]).where("tests or not coalesce(is_test, false)").select("query_id", "repo", "id", "at")
    found = cut(budgeted_expansion(kept, n, e, budget))
    rest = kept.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "repo", "id", F.col("at").cast("int").alias("position"))
    shown = found.select("query_id", "repo", "id", "position").unionByName(rest).where(F.col("position") <= RENDERED).join(n, ["repo", "id"])
    shown = shown.join(codes, ["repo", "id"]).dropDuplicates(["query_id", "repo", "id"])
    item = F.concat(F.lit("## "), F.col("position"), F.lit(". "), F.coalesce("name", F.lit("Unknown")), F.lit(" ("), F.coalesce("file", F.lit("Unknown")), F.lit(")\n"), text.or_empty(F.col("code")))
    ctx = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", item.alias("item")))), lambda x: x["item"]), "\n\n").alias("context"))
    return questions.join(ctx, "query_id", "left").select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nText:\n"), F.coalesce("context", F.lit("Nothing was found."))).alias("prompt"))


@query
def answer_prompts(spark: SparkSession, d: str):
    """One question per repository, seeded with its first entry points."""
    n = nodes(spark, d, "name", "file", text.token_estimate(F.col("code")).alias("size"), "is_test", "is_entry_point")
    q = n.select(F.col("repo").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("How does "), "query_id", F.lit(" work?")))
    seeds = ranked(n.where("is_entry_point"), ["repo"], ["id"], 20, "at").select(F.col("repo").alias("query_id"), "repo", "id", "at")
    return summarise(answer(q, seeds, n, edges(spark, d), table(spark, d, "chunks").select("repo", "id", "code")), "prompt", "reply").select("query_id", F.length("prompt").alias("prompt_chars"), "reply")


@query
def tech_stack(spark, d):
    """Outside packages per repository, by how many files import them."""
    known = table(spark, d, "externals").where("kind = 'package'").select("language", F.col("symbol").alias("from_path"))
    i = nodes(spark, d, "file", "language", "imports_map").select("repo", "file", "language", F.explode(F.map_values("imports_map")).alias("i")).select("repo", "file", "language", F.col("i.from_path").alias("from_path")).distinct()
    return i.join(known, ["language", "from_path"], "left_semi").groupBy("repo", "language", "from_path").agg(F.count_distinct("file").alias("n_files"))


SQL["tech_stack"] = """select repo, language, from_path, count(distinct file) n_files from (select distinct repo, file, language, unnest(map_values(imports_map)).from_path from_path from (select distinct on (repo, id) * from chunks)) i
 where exists (select 1 from externals x where x.kind='package' and x.language=i.language and x.symbol=i.from_path) group by 1,2,3"""
