"""Operators around the levels of a code base: packages, call chains by name, rule tables, checked summaries.

Defined results: null names, texts and lists match nothing; rows delivered twice
count once; ties go to the smaller id; extra columns are not read.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.functions import paths, text
from treadle.functions.imports import imports_of
from treadle.operators import summaries
from treadle.operators.graph import _E, _N, PACKAGE_LINKS, edges, linked, nodes, ordered_walk, ranked
from treadle.operators.vector import embed, nearest
from treadle.session import cut, table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- packages and paths


@query(f"""select repo, package, depended_by, n from (select e.repo, b.package_name package, a.package_name depended_by, count(*) n, row_number() over (partition by e.repo, b.package_name order by a.package_name) r
 from {_E} e join {_N} a on e.repo=a.repo and e.src=a.id join {_N} b on e.repo=b.repo and e.dst=b.id where e.rel='CALLS' and a.package_name <> b.package_name and a.package_name <> '' and b.package_name <> '' group by 1,2,3) where r <= {PACKAGE_LINKS}""")
def package_depended_by(spark, d):
    n = linked(spark, d, "package_name").groupBy("repo", "a", "b").agg(F.count("*").alias("n"))
    return ranked(n, ["repo", "b"], ["a"], PACKAGE_LINKS).select("repo", F.col("b").alias("package"), F.col("a").alias("depended_by"), "n")


_DIR = "case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '' end"


@query(f"select repo, {_DIR} package, file, id, coalesce(entry_point_type, '') entry_type from {_N} where is_entry_point and file is not null")
def entry_points_by_path(spark, d):
    """Code base, package directory, file and chunk of every entry point."""
    n = nodes(spark, d, "file", "is_entry_point", "entry_point_type").where("is_entry_point and file is not null")
    return n.select("repo", paths.parent_dir(F.col("file")).alias("package"), "file", "id", text.or_empty(F.col("entry_point_type")).alias("entry_type"))


@query(f"""select e.repo, a.p package, b.p other, count(*) n from {_E} e join (select repo, id, {_DIR} p from {_N} where file is not null) a on e.repo=a.repo and e.src=a.id
 join (select repo, id, {_DIR} p from {_N} where file is not null) b on e.repo=b.repo and e.dst=b.id where e.rel in ('CALLS','IMPORTS') and a.p <> b.p group by 1,2,3""")
def directory_dependencies(spark, d):
    """Calls and imports between package directories, counted."""
    p = nodes(spark, d, "file").where("file is not null").select("repo", "id", paths.parent_dir(F.col("file")).alias("p"))
    e = edges(spark, d, "CALLS", "IMPORTS")
    j = e.join(p.toDF("repo", "src", "package"), ["repo", "src"]).join(p.toDF("repo", "dst", "other"), ["repo", "dst"]).where("package <> other")
    return j.groupBy("repo", "package", "other").agg(F.count("*").alias("n"))


@query(f"""select repo, entry_type, n, array_to_string(ids, ',') ids from (select repo, coalesce(entry_point_type, '') entry_type, count(*) n, (list(id order by id))[1:20] ids from {_N} where is_entry_point group by 1, 2)""")
def entry_points_grouped(spark, d):
    """Entry points of each type, the first twenty by id."""
    n = nodes(spark, d, "is_entry_point", "entry_point_type").where("is_entry_point").select("repo", text.or_empty(F.col("entry_point_type")).alias("entry_type"), "id")
    some = ranked(n, ["repo", "entry_type"], ["id"], 20).groupBy("repo", "entry_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return n.groupBy("repo", "entry_type").agg(F.count("*").alias("n")).join(some, ["repo", "entry_type"]).select("repo", "entry_type", "n", "ids")


CHAIN_NODES, CHAIN_WIDTH = 50, 5


def call_chain(n: DataFrame) -> DataFrame:
    """``(repo, entry, step, id)``: from every entry point over the first ``CHAIN_WIDTH`` call names, each to the
    first chunk of that name by file, line and id, first in first out, up to ``CHAIN_NODES`` chunks."""
    first = n.where("name is not null").groupBy("repo", "name").agg(F.min(F.struct("file", "start_line", "id"))["id"].alias("other"))
    calls = n.select("repo", "id", F.posexplode(F.slice("calls", 1, CHAIN_WIDTH)).alias("rank", "name"))
    step = calls.join(first, ["repo", "name"]).groupBy("repo", "id", "other").agg(F.min("rank").alias("rank"))
    return ordered_walk(n.where("is_entry_point").select("repo", "id"), cut(step), CHAIN_NODES)


@query()
def call_chain_by_name(spark, d):
    return call_chain(nodes(spark, d, "name", "file", "start_line", "calls", "is_entry_point"))


# --- text rules

# What asks for a diagram.
DIAGRAM = (
    r"\bflow\b", r"\bdiagram\b", r"\bvisuali[sz]e\b", r"\barchitecture\b", r"\bstructure\b", r"\bhow\s+does\b",
    r"\bsequence\b", r"\bprocess\b", r"\bpipeline\b", r"\bworkflow\b", r"\bcall\s*graph\b", r"\bdependenc",
)


def wants_diagram(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(DIAGRAM)), F.lit(False))


@query(f"select doc_id, coalesce(regexp_matches(lower(text), '{'|'.join(DIAGRAM)}'), false) diagram from documents")
def diagram_intent(spark, d):
    return table(spark, d, "documents").select("doc_id", wants_diagram(F.col("text")).alias("diagram"))


#: Rules of entry points over decorators: wildcards and alternatives, the kind, and which part is extracted.
RULES = (
    ("@*.{get|post|put|delete|patch}(*)", "http_endpoint"), ("@*.route(*)", "http_endpoint"), ("@{GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping}(*)", "http_endpoint"),
    ("@KafkaListener(*)", "kafka_listener"), ("@*.consumer(*)", "kafka_listener"), ("@*.command(*)", "cli_command"), ("@*.{task|shared_task}*", "scheduled_job"), ("@*.schedule(*)", "scheduled_job"), ("@Scheduled(*)", "scheduled_job"),
)


def wildcard(pattern: str) -> str:
    """A whole-string regular expression: ``*`` is any text, ``{a|b}`` one of several, the rest itself; a leading ``@`` may be absent."""
    out = "@?" if pattern.startswith("@") else ""
    for part in re.findall(r"\{[^}]*\}|\*|[^{*]+", pattern.removeprefix("@")):
        out += ".*" if part == "*" else "(?:" + "|".join(map(re.escape, part[1:-1].split("|"))) + ")" if part[0] == "{" else re.escape(part)
    return f"^{out}$"


def ruled(decorator: Column, rules=RULES) -> Column:
    """The kind of the first rule that matches; null of none."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        kind = F.when(decorator.rlike("(?s)" + wildcard(pattern)), name).otherwise(kind)
    return kind


_RULED = "case " + " ".join(f"when regexp_matches(x, '{wildcard(p)}', 's') then '{k}'" for p, k in RULES) + " end"


@query(f"""select repo, id, x as decorator, {_RULED} kind, nullif(regexp_extract(x, '["'']([^"'']*)["'']', 1), '') as said from (select distinct repo, id, unnest(decorators) x from {_N}) where {_RULED} is not null""")
def rule_entry_points(spark, d):
    """Decorators that a rule names, and the first string they carry."""
    x = nodes(spark, d, "decorators").select("repo", "id", F.explode("decorators").alias("decorator")).distinct()
    said = F.nullif(F.regexp_extract("decorator", "[\"']([^\"']*)[\"']", 1), F.lit(""))
    return x.withColumn("kind", ruled(F.col("decorator"))).where("kind is not null").select("repo", "id", "decorator", "kind", said.alias("said"))


def grounded(summary: Column, name: Column, calls: Column) -> Column:
    """Whether a summary names its chunk and one of its calls, or says that it calls; a chunk without calls needs its name only."""
    named = F.coalesce(F.contains(summary, name), F.lit(False))
    called = F.contains(summary, F.lit("calls")) | F.exists(calls, lambda c: F.coalesce(F.contains(summary, c), F.lit(False)))
    return named & F.coalesce((F.size(calls) <= 0) | calls.isNull() | called, F.lit(False))


@query(f"""select repo, id, coalesce(contains(situating_context, name), false) and coalesce(calls is null or len(calls) = 0 or contains(situating_context, 'calls') or len(list_filter(calls, lambda c: coalesce(contains(situating_context, c), false))) > 0, false) grounded
 from {_N} where situating_context <> ''""")
def summaries_grounded(spark, d):
    n = nodes(spark, d, "situating_context", "name", "calls").where("situating_context <> ''")
    return n.select("repo", "id", grounded(F.col("situating_context"), F.col("name"), F.col("calls")).alias("grounded"))


def classifier(prompts: list[str]) -> list[str]:
    """The offline classifier: JSON with a type, a confidence and its evidence, from the words of the decorators."""
    out = []
    for p in prompts:
        said = (p or "").rpartition("Decorators: ")[2].split("\n")
        kind = next((k for x in said[0].split(" | ") for pattern, k in RULES if x and re.match(wildcard(pattern), x, re.S)), None)
        main = "Name: main\n" in (p or "")
        out.append(json.dumps({"is_entry_point": bool(kind or main), "type": kind or ("main" if main else "other"), "confidence": 0.9 if kind else 0.6 if main else 0.2, "evidence": said[0] if kind else ""}))
    return out


summaries.MODELS["classifier"] = classifier


def assisted(df: DataFrame, threshold: float = 0.5, model: str = "classifier") -> DataFrame:
    """``(repo, id, type, confidence, evidence)`` of chunks a model takes for entry points with enough confidence; replies that are no JSON count as none."""
    prompt = F.concat(F.lit("Name: "), text.or_empty(F.col("name")), F.lit("\nDecorators: "), F.array_join("decorators", " | "), F.lit("\nIs this an entry point? Reply in JSON."))
    r = summaries.summarise(df.withColumn("prompt", prompt), "prompt", "reply", model)
    r = r.withColumn("r", F.from_json("reply", "is_entry_point boolean, type string, confidence double, evidence string"))
    return r.where(F.col("r.is_entry_point") & (F.col("r.confidence") >= threshold)).select("repo", "id", "r.type", "r.confidence", "r.evidence")


@query()
def assisted_entry_points(spark, d):
    return assisted(nodes(spark, d, "name", "decorators"))


# --- imports of raw text, records of older forms, identifiers


def imported_names(content: Column, language: Column) -> Column:
    """``(name, path)`` of the imports of a text."""

    @F.pandas_udf("array<struct<name:string,path:string>>")
    def run(contents: pd.Series, languages: pd.Series) -> pd.Series:
        known = ("python", "java", "go", "javascript", "typescript")
        return pd.Series([[{"name": n, "path": p} for n, p in imports_of(c, x)[1].items()] if c and x in known else [] for c, x in zip(contents, languages)])

    return run(content, language)


def _sources(spark, d) -> DataFrame:
    return table(spark, d, "source_files").where("content is not null").select("repo", "path", "content").distinct()


@query()
def import_names(spark, d):
    """Local names of all imports of all files, with the paths they stand for."""
    s = _sources(spark, d).withColumn("language", text.language_of(F.col("path")))
    i = s.select("repo", F.col("path").alias("file"), F.explode(imported_names(F.col("content"), F.col("language"))).alias("i"))
    return i.select("repo", "file", "i.name", "i.path").distinct()


_FROM = r"(?m)^from[ \t]+([\w.]+)[ \t]+import[ \t]+([\w, \t]+)$"


@query(rf"""select distinct repo, path as file, m as "module", trim(split_part(trim(x), ' as ', 1)) as name, trim(coalesce(nullif(split_part(trim(x), ' as ', 2), ''), trim(x))) as local_name from (
  select repo, path, m, unnest(string_split(names, ',')) x from (select repo, path, unnest(regexp_extract_all(content, '{_FROM}', 1)) m, unnest(regexp_extract_all(content, '{_FROM}', 2)) names from source_files where content is not null and path like '%.py')) where trim(x) <> ''""")
def import_comma_lists(spark, d):
    """Names of Python import lists with ``as``."""
    s = _sources(spark, d).where("path like '%.py'")
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(_FROM), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(_FROM), F.lit(2)).alias("n"))
    x = s.select("repo", F.col("path").alias("file"), F.explode(z).alias("z")).select("repo", "file", F.col("z.m").alias("module"), F.explode(F.split("z.n", ",")).alias("x"))
    p = F.split(F.trim("x"), " as ")
    return x.where("trim(x) <> ''").select("repo", "file", "module", F.trim(F.get(p, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0)))).alias("local_name")).distinct()


def migrated(record: Column, schema: str, renamed: dict[str, str]) -> Column:
    """A JSON record under today's fields: renamed ones are read under both names, today's first; unknown ones are dropped."""
    old = ", ".join(f"{k} string" for k in renamed)
    p = F.from_json(record, f"{schema}, {old}")
    return F.struct(*(F.coalesce(p[f], *(p[k] for k, v in renamed.items() if v == f)).alias(f) for f in re.findall(r"(?:^|, )(\w+) ", schema)))


@query(f"select repo, id, name, receiver_type, start_line from {_N}")
def record_migration(spark, d):
    """Chunks stored under an older name of a field, with a field that is no longer known, read as today's."""
    n = nodes(spark, d, "name", "receiver_type", "start_line")
    late = F.pmod(F.xxhash64("repo", "id"), F.lit(2)) == 0
    old = F.to_json(F.struct("name", "start_line", F.when(late, F.col("receiver_type")).alias("receiver_type"), F.when(~late, F.col("receiver_type")).alias("reciever_type"), F.lit("x").alias("gone")))
    m = n.select("repo", "id", migrated(old, "name string, receiver_type string, start_line int", {"reciever_type": "receiver_type"}).alias("m"))
    return m.select("repo", "id", "m.name", "m.receiver_type", "m.start_line")


@query("""select repo, form, lower(case form when 'path' then replace(repo, '__', '-') else repo end) as name from (select distinct repo from chunks), (values ('url'), ('path'), ('slash')) f(form) where contains(repo, '__')""")
def repo_identifiers(spark, d):
    """Names of repositories from URLs, with and without ending, and from paths."""
    r = table(spark, d, "chunks").select("repo").distinct().where("contains(repo, '__')")
    forms = F.array(
        F.struct(F.lit("url").alias("form"), F.concat(F.lit("https://code.test/"), F.replace(F.col("repo"), F.lit("__"), F.lit("/")), F.lit(".git")).alias("given")),
        F.struct(F.lit("path").alias("form"), F.concat(F.lit("/srv/work/"), F.replace(F.col("repo"), F.lit("__"), F.lit("-"))).alias("given")),
        F.struct(F.lit("slash").alias("form"), F.concat(F.lit("https://code.test/"), F.replace(F.col("repo"), F.lit("__"), F.lit("/")), F.lit("/")).alias("given")),
    )
    return r.select("repo", F.explode(forms).alias("f")).select("repo", "f.form", text.repo_name(F.col("f.given")).alias("name"))


@query(f"""select distinct repo, file, from_path, replace(from_path, '.', '/') path from (select repo, file, unnest(map_values(imports_map)).from_path from_path from {_N} where language = 'python' and file is not null) where from_path <> '' and not starts_with(from_path, '.')
 union all select distinct repo, file, '..' || name, concat_ws('/', nullif(array_to_string((string_split({_DIR}, '/'))[1:greatest(len(string_split({_DIR}, '/')) - 1, 0)], '/'), ''), name) from {_N} where language = 'python' and file is not null and name <> '' and regexp_full_match(name, '\\w+')""")
def python_import_paths(spark, d):
    """Dotted modules as paths; each name also as a module of the package above its file."""
    n = nodes(spark, d, "file", "language", "name", "imports_map").where("language = 'python' and file is not null")
    i = n.select("repo", "file", F.explode(F.map_values("imports_map")).alias("i")).select("repo", "file", F.col("i.from_path").alias("from_path")).where("from_path <> '' and not startswith(from_path, '.')").distinct()
    above = n.where(r"name rlike '^[A-Za-z0-9_]+$'").select("repo", "file", F.concat(F.lit(".."), F.col("name")).alias("from_path")).distinct()
    return i.unionByName(above).select("repo", "file", "from_path", paths.python_module_path(F.col("from_path"), paths.parent_dir(F.col("file"))).alias("path"))


#: Hosts of modules from outside in the tables.
TABLE_HOSTS = ("pkgs.example/",)


@query(f"""select i.repo, string_split(from_path, '/')[least(3, len(string_split(from_path, '/')))] as dep, count(*) n from (select repo, unnest(map_values(imports_map)).from_path from_path from {_N} where language = 'go') i
 left join (select repo, min(nullif("module", '')) as mod from go_mod group by 1) m using (repo) where starts_with(from_path, 'pkgs.example/') and not coalesce(starts_with(from_path, mod || '/') or from_path = mod, false) group by 1, 2""")
def external_dependencies(spark, d):
    """Go modules from outside each repository, by the name after host and owner."""
    i = nodes(spark, d, "language", "imports_map").where("language = 'go'").select("repo", F.explode(F.map_values("imports_map")).alias("i")).select("repo", F.col("i.from_path").alias("p"))
    mods = table(spark, d, "go_mod").groupBy("repo").agg(F.min(F.nullif("module", F.lit(""))).alias("module"))
    own = F.coalesce(F.expr("startswith(p, module || '/') or p = module"), F.lit(False))
    i = i.join(mods, "repo", "left").where(F.col("p").startswith(TABLE_HOSTS[0]) & ~own)
    parts = F.split("p", "/")
    return i.groupBy("repo", F.get(parts, F.least(F.lit(2), F.size(parts) - 1)).alias("dep")).agg(F.count("*").alias("n"))


# --- an index of all levels


def reply_vectors(reply: Column) -> Column:
    """Embeddings of a provider's JSON reply in the order of their ``index``, whatever order they came in."""
    data = F.from_json(reply, "data array<struct<index:int,embedding:array<float>>>")["data"]
    return F.transform(F.array_sort(data), lambda x: x["embedding"])


@query("select vec_id, embedding[1]::float as first, len(embedding)::int as size from embeddings")
def embedding_replies(spark, d):
    """Batches of thirty-two vectors as replies in reversed order, read back by index."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding").withColumn("batch", F.floor(F.col("vec_id") / 32))
    b = e.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    data = F.reverse(F.transform("x", lambda v, i: F.struct(i.alias("index"), v["embedding"].alias("embedding"))))
    b = b.select("x", reply_vectors(F.to_json(F.struct(data.alias("data")))).alias("v"))
    z = b.select(F.explode(F.arrays_zip(F.transform("x", lambda v: v["vec_id"]).alias("vec_id"), F.col("v"))).alias("z"))
    return z.select("z.vec_id", F.get("z.v", F.lit(0)).alias("first"), F.size("z.v").alias("size"))


def level_texts(n: DataFrame) -> DataFrame:
    """``(level, key, text)`` of chunks, files, packages and code bases; what stands above a chunk is told by names, in bounded lists."""
    named = n.where("name is not null")

    def above(level: str, *keys: str) -> DataFrame:
        some = ranked(named.where(F.col(keys[-1]).isNotNull()).select(*keys, "name").distinct(), list(keys), ["name"], 50)
        words = F.concat_ws(" ", F.lit(level), *keys, F.array_join(F.array_sort(F.collect_list("name")), " "))
        return some.groupBy(*keys).agg(words.alias("text")).select(F.lit(level).alias("level"), F.concat_ws("::", *keys).alias("key"), "text")

    own = named.select(F.lit("chunk").alias("level"), F.concat_ws("::", "repo", "id").alias("key"), F.concat_ws(" ", "name", "signature", "docstring").alias("text"))
    return own.unionByName(above("file", "repo", "file")).unionByName(above("package", "repo", "package_name")).unionByName(above("codebase", "repo"))


@query()
def level_search(spark, d):
    """The three nearest of each level to every hundredth record of it, by the hash of its key."""
    t = level_texts(nodes(spark, d, "name", "file", "package_name", "signature", "docstring")).withColumn("id", F.xxhash64("level", "key"))
    e = cut(embed(t, "text").select("level", "id", F.col("embedding").alias("v")))
    out = None
    for level in ("chunk", "file", "package", "codebase"):
        part = e.where(F.col("level") == level)
        found = nearest(part.where("id % 100 = 0"), part, 3).select(F.lit(level).alias("level"), "query_id", "id", "rank")
        out = found if out is None else out.unionByName(found)
    return out
