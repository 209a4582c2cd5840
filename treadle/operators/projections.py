"""Queries of projections, predicates and scalar text functions over the chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions import paths, text
from treadle.session import table


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chunks once each; rows that were delivered twice are alike in these columns."""
    return table(spark, d, "chunks").select("chunk_no", *cols).dropDuplicates(["chunk_no"])


def _imports(spark, d, *languages):
    one = _chunks(spark, d, "repo", "file", "language", "imports_map").where(F.col("language").isin(*languages))
    return one.select("repo", "file", "language", F.explode(F.map_values("imports_map")).alias("i")).select("repo", "file", "language", F.col("i.from_path").alias("from_path")).where("from_path is not null").distinct()


_ONE = "(select distinct on (chunk_no) * from chunks)"
_IMP = f"(select distinct repo, file, language, i.from_path from (select repo, file, language, unnest(map_values(imports_map)) i from {_ONE}) where i.from_path is not null)"


def _sql_any(col, values, how="contains"):
    f = {"contains": "contains({c}, '{v}')", "starts": "starts_with({c}, '{v}')"}[how]
    return "(" + " or ".join(f.format(c=col, v=v) for v in values) + ")"


QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""select chunk_no, coalesce(name,'') as "name", coalesce(file,'') as file, coalesce(substr(code,1,5000),'') code, coalesce(substr(docstring,1,500),'') docstring,
 coalesce(signature,'') signature, coalesce(receiver_type,'') receiver_type, package_name from {_ONE}""")
def chunk_projection_truncate(spark, d):
    o = text.or_empty
    return _chunks(spark, d, "name", "file", "code", "docstring", "signature", "receiver_type", "package_name").select(
        "chunk_no", o(F.col("name")).alias("name"), o(F.col("file")).alias("file"), o(F.substring("code", 1, 5000)).alias("code"), o(F.substring("docstring", 1, 500)).alias("docstring"),
        o(F.col("signature")).alias("signature"), o(F.col("receiver_type")).alias("receiver_type"), "package_name")


_CTX = """concat_ws(chr(10), coalesce(chunk_type, '') || ': ' || coalesce(name, ''), 'File: ' || coalesce(file, ''), case when signature <> '' then 'Signature: ' || signature end,
 case when docstring <> '' then 'Description: ' || case when length(docstring) > 300 then docstring[1:300] || '...' else docstring end end,
 case when len(decorators) > 0 then 'Decorators: ' || array_to_string(decorators, ', ') end,
 case when len(params) > 0 then 'Parameters: ' || array_to_string(list_transform(params, lambda p: coalesce(p.name,'') || ': ' || coalesce(nullif(p.type,''),'any')), ', ') end,
 case when "returns" <> '' then 'Returns: ' || "returns" end, case when len(calls) > 0 then 'Calls: ' || array_to_string(calls[1:10], ', ') end,
 case when parent <> '' then 'In: ' || string_split(parent,'::')[-1] end,
 case when is_entry_point then concat_ws(' | ', 'Entry point type: ' || coalesce(entry_point_type,''), case when entry_point_route <> '' then 'Route/topic: ' || entry_point_route end, case when entry_point_method <> '' then 'HTTP method: ' || entry_point_method end) end,
 case when len(implements) > 0 then 'Implements: ' || array_to_string(implements, ', ') end, case when package_name <> '' then 'Package: ' || package_name end)"""
_CTX_COLS = ("repo", "chunk_type", "name", "file", "signature", "docstring", "decorators", "params", "returns", "calls", "parent", "is_entry_point", "entry_point_type", "entry_point_route", "entry_point_method", "implements", "package_name")


@query(f"select chunk_no, {_CTX} context from {_ONE}")
def context_string(spark, d):
    return _chunks(spark, d, *_CTX_COLS).select("chunk_no", text.context_string().alias("context"))


@query(f"""select chunk_no, md5(case when use_contextual_embedding and coalesce(contextual_embedding_text,'') <> '' then contextual_embedding_text
 else concat_ws(chr(10) || chr(10), {_CTX}, coalesce(code,'')) end) digest from {_ONE}""")
def embedding_text_fallback(spark, d):
    return _chunks(spark, d, *_CTX_COLS, "code", "use_contextual_embedding", "contextual_embedding_text").select("chunk_no", F.md5(F.encode(text.embedding_text(), "UTF-8")).alias("digest"))


@query(f"""select chunk_no, md5(concat_ws(chr(10), case when situating_context <> '' then '<context>' || chr(10) || situating_context || chr(10) || '</context>' || chr(10) end,
 'File: ' || coalesce(file, '') || ' (lines ' || start_line || '-' || end_line || ') [' || coalesce(language, '') || ']',
 case when signature <> '' then coalesce(chunk_type, '') || ': ' || signature end, case when docstring <> '' then 'Doc: ' || docstring[1:200] end,
 case when is_entry_point then concat_ws(' ', 'Entry point: ' || coalesce(entry_point_type, ''), nullif(entry_point_method, ''), nullif(entry_point_route, '')) end,
 '```' || coalesce(language,'') || chr(10) || coalesce(code,'') || chr(10) || '```')) digest from {_ONE}""")
def llm_context_render(spark, d):
    c = _chunks(spark, d, "chunk_type", "file", "start_line", "end_line", "signature", "docstring", "is_entry_point", "entry_point_type", "entry_point_method", "entry_point_route", "situating_context", "language", "code")
    return c.select("chunk_no", F.md5(F.encode(text.llm_context(), "UTF-8")).alias("digest"))


@query(f"select repo, file, {_sql_any('lower(file)', text.TEST_PATHS)} is_test from (select distinct repo, file from chunks)")
def is_test_path(spark, d):
    return table(spark, d, "chunks").select("repo", "file").distinct().select("repo", "file", text.is_test_path(F.col("file")).alias("is_test"))


@query(f"""select chunk_no, starts_with(coalesce(name,''),'test_') or starts_with(coalesce(name,''),'Test') or coalesce(list_has_any(decorators, ['Test','pytest.mark','unittest']), false) is_test from {_ONE}""")
def is_test_name(spark, d):
    return _chunks(spark, d, "name", "decorators").select("chunk_no", text.is_test_chunk(F.col("name"), F.col("decorators")).alias("is_test"))


@query(f"""select repo, path, {"regexp_matches(path, '(^|/)(" + "|".join(x.replace(".", "[.]") for x in text.IGNORED_DIRS) + ")/')"} ignored from (select distinct repo, path from source_files)""")
def ignore_pattern_filter(spark, d):
    return table(spark, d, "source_files").select("repo", "path").distinct().select("repo", "path", text.is_ignored(F.col("path")).alias("ignored"))


@query("select language, count(*) n from (select distinct repo, path, case " + " ".join(f"when lower(regexp_extract(path, '([.][^./]+)$', 1)) = '{k}' then '{v}'" for k, v in text.LANGUAGES.items()) + " end as language from source_files) group by 1")
def extension_language_join(spark, d):
    return table(spark, d, "source_files").select("repo", "path").distinct().groupBy(text.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("select repo, path, octet_length(encode(content)) n_bytes, octet_length(encode(content)) <= 1048576 fits from (select distinct repo, path, content from source_files where content is not null)")
def utf8_size_filter(spark, d):
    s = table(spark, d, "source_files").where("content is not null").distinct()
    return s.select("repo", "path", F.octet_length("content").cast("long").alias("n_bytes"), (F.octet_length("content") <= text.MAX_FILE_BYTES).alias("fits"))


@query(f"select chunk_no, (length(code)//4)::int tokens from {_ONE}")
def token_estimate(spark, d):
    return _chunks(spark, d, "code").select("chunk_no", text.token_estimate(F.col("code")).alias("tokens"))


@query(f"select chunk_no, substr(md5(code),1,8) digest from {_ONE}")
def content_hash_prefix(spark, d):
    return _chunks(spark, d, "code").select("chunk_no", text.content_hash(F.col("code")).alias("digest"))


@query("select doc_id, text || ' [' || substr(md5(text),1,8) || ']' hashed, true as same from documents where text is not null")
def hash_suffix_roundtrip(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "text", text.with_hash(F.col("text"), text.content_hash(F.col("text"))).alias("hashed"))
    return x.select("doc_id", "hashed", (text.without_hash(F.col("hashed")) == F.col("text")).alias("same"))


@query(f"select chunk_no, length(name) >= 2 and regexp_matches(name, '^[\\p{{L}}_]') and name not in ('_','if','for','new','nil','null','undefined') valid from {_ONE} where name is not null")
def name_validity(spark, d):
    return _chunks(spark, d, "name").where("name is not null").select("chunk_no", text.valid_name(F.col("name")).alias("valid"))


@query(f"""select distinct raw, regexp_replace(trim(raw), '^(\\*|\\[\\d*\\])+', '') bare, case when contains(regexp_replace(trim(raw), '^(\\*|\\[\\d*\\])+', ''), '.') then split_part(regexp_replace(trim(raw), '^(\\*|\\[\\d*\\])+', ''), '.', 1) else '' end qualifier
 from (select unnest(map_values(type_map)) raw from {_ONE} union all select unnest(['*models.User','[]*models.User','[4]*models.User','[][]string','map[string]*User','chan *User'])) where raw is not null""")
def type_decorator_strip(spark, d):
    seen = _chunks(spark, d, "type_map").select(F.explode(F.map_values("type_map")).alias("raw"))
    extra = spark.createDataFrame([(x,) for x in ("*models.User", "[]*models.User", "[4]*models.User", "[][]string", "map[string]*User", "chan *User")], "raw string")
    bare = text.bare_type(F.col("raw"))
    return seen.unionByName(extra).where("raw is not null").distinct().select("raw", bare.alias("bare"), text.qualifier(bare).alias("qualifier"))


@query(f"select distinct from_path, case when not (ends_with(from_path,'.*') or {_sql_any('from_path', text.JAVA_EXTERNAL, 'starts')}) then replace(from_path,'.','/') end path from {_IMP} where language='java'")
def dotted_to_path(spark, d):
    return _imports(spark, d, "java").select("from_path").distinct().select("from_path", text.java_import_path(F.col("from_path")).alias("path"))


@query(f"""select distinct from_path, file, array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(list_filter(string_split(case when contains(file,'/') then regexp_replace(file,'/[^/]*$','') || '/' || from_path else from_path end,'/'),
 lambda s: s <> '' and s <> '.'), lambda s: [s])), lambda a, s: case when s[1] = '..' then a[1:len(a)-1] else list_concat(a, s) end), '/') path from {_IMP} where language in ('javascript','typescript') and starts_with(from_path,'.')""")
def relative_path_normalise(spark, d):
    i = _imports(spark, d, "javascript", "typescript").where(F.col("from_path").startswith(".")).select("from_path", "file").distinct()
    return i.select("from_path", "file", paths.folded_path(F.concat_ws("/", F.nullif(paths.parent_dir(F.col("file")), F.lit("")), F.col("from_path"))).alias("path"))


_GO_IMP = f"(select i.*, m.module from {_IMP} i left join (select repo, min(nullif(module,'')) as module from go_mod group by 1) m using (repo) where language='go')"


@query(f"""select distinct repo, from_path, coalesce(starts_with(from_path, module), false) or not {_sql_any('from_path', text.GO_EXTERNAL_HOSTS, 'starts')} internal,
 case when coalesce(starts_with(from_path, module), false) then case when regexp_replace(substr(from_path, length(module)+1),'^/+','') = '' then '.' else regexp_replace(substr(from_path, length(module)+1),'^/+','') end
  when contains(from_path,'/') then regexp_replace(from_path,'^[^/]*/','') else from_path end dir from {_GO_IMP}""")
def include_external_internal(spark, d):
    mods = table(spark, d, "go_mod").groupBy("repo").agg(F.min(F.nullif("module", F.lit(""))).alias("module"))
    i = _imports(spark, d, "go").select("repo", "from_path").distinct().join(mods, "repo", "left")
    m = F.coalesce("module", F.lit(""))
    return i.select("repo", "from_path", text.is_internal_import(F.col("from_path"), m).alias("internal"), text.import_dir(F.col("from_path"), m).alias("dir"))


@query(f"select repo, case when cardinality(p) >= 3 then p[3] else p[2] end dep, count(*) n from (select repo, string_split(from_path,'/') p from {_IMP} where language='go' and {_sql_any('from_path', text.GO_EXTERNAL_HOSTS, 'starts')} and contains(from_path,'/')) group by all")
def external_dep_names(spark, d):
    i = _imports(spark, d, "go").select("repo", "file", text.dependency_name(F.col("from_path")).alias("dep")).where("dep is not null")
    return i.groupBy("repo", "dep").agg(F.count("*").alias("n"))


@query(r"select repo, path, regexp_extract(content, '^(\s|//[^\n]*\n|/\*(?:[^*]|\*+[^*/])*\*+/)*package[ \t]+(\w+)', 2) package from (select distinct repo, path, content from source_files where content is not null and path like '%.go') where regexp_matches(content, '^(\s|//[^\n]*\n|/\*(?:[^*]|\*+[^*/])*\*+/)*package[ \t]+(\w+)')")
def package_clause_any_header(spark, d):
    """Of all Go files, those that begin with a block comment as well."""
    s = table(spark, d, "source_files").where("content is not null and path like '%.go'").distinct()
    return s.select("repo", "path", text.package_clause(F.col("content")).alias("package")).where("package is not null")


@query(f"select repo, lower(case when length(b) < 3 then b || '_db' else b end) || '_entities' as \"collection\" from (select repo, substr(lower(replace(replace(repo,'/','_'),'.','_')),1,50) b from (select distinct repo from chunks))")
def repo_name_normalise(spark, d):
    return table(spark, d, "chunks").select("repo").distinct().select("repo", text.collection_name(F.col("repo")).alias("collection"))


@query(f"select chunk_no, case when entry_point_route <> '' then trim(concat_ws(' ', entry_point_type, entry_point_route)) else name end flow from {_ONE} where is_entry_point")
def flow_naming(spark, d):
    return _chunks(spark, d, "name", "is_entry_point", "entry_point_type", "entry_point_route").where("is_entry_point").select("chunk_no", text.flow_name(F.col("entry_point_type"), F.col("entry_point_route"), F.col("name")).alias("flow"))


@query(f"select chunk_no, trim(p) param from (select chunk_no, unnest(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ',')) p from {_ONE} where contains(signature, '(')) where trim(p) <> ''")
def comma_list_split(spark, d):
    parts = F.split(F.regexp_extract("signature", r"\((.*)\)", 1), ",")
    return _chunks(spark, d, "signature").where("contains(signature, '(')").select("chunk_no", F.explode(parts).alias("p")).select("chunk_no", F.trim("p").alias("param")).where("param <> ''")


@query(f"select chunk_no, unnest(list_distinct(list_filter(calls, lambda x: x not in {text.BUILTIN_CALLS!r}))) call_name from {_ONE}")
def calls_minus_builtins(spark, d):
    c = F.array_except(F.array_distinct("calls"), F.array(*map(F.lit, text.BUILTIN_CALLS)))
    return _chunks(spark, d, "calls").select("chunk_no", F.explode(c).alias("call_name")).where("call_name is not null")


@query("select event_id, json_extract_string(props,'$.k')::bigint k, json_extract_string(props,'$.receiver_type') receiver_type from events")
def schema_migrate_json(spark, d):
    """A field that was renamed is read under both names, unknown ones are dropped."""
    p = F.from_json("props", "k long, receiver_type string, reciever_type string")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["receiver_type"], p["reciever_type"]).alias("receiver_type"))


@query("""select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int part, md5(trim(p, chr(10))) digest from
 (select doc_id, unnest(string_split(text, '```')) p, generate_subscripts(string_split(text, '```'), 1) i from documents where contains(text, '```')) where trim(p, chr(10)) <> ''""")
def fenced_block_split(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "documents").where("contains(text, '```')").select("doc_id", F.posexplode(F.split("text", "```")).alias("i", "p")).withColumn("p", F.expr("trim(BOTH '\n' FROM p)")).where("p <> ''")
    return x.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).alias("part"), F.md5(F.encode("p", "UTF-8")).alias("digest"))


@query("select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{p.replace(chr(92) + 'b', '')}') then '{n}'" for n, p in text.INTENTS if chr(92) not in p) .replace("when regexp_matches(lower(text), 'architecture", "when regexp_matches(lower(text), 'how does|how do|flow|feature|works?\\b') then 'feature' when regexp_matches(lower(text), 'architecture") + " else 'implementation' end intent from documents where text is not null")
def intent_router(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.intent(F.col("text")).alias("intent"))


@query("select doc_id, unnest(list_prepend(lines[1], lines[2:4])) expanded from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') lines from documents where text is not null) where len(lines) > 0")
def query_expand(spark, d):
    """The first line as the query, and up to three more lines as its expansions."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    x = table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("lines")).where("size(lines) > 0")
    return x.select("doc_id", F.explode(F.slice("lines", 1, 4)).alias("expanded"))


@query("select doc_id, block::bigint block, string_agg(line, chr(10) order by i) body from (select *, sum(case when regexp_matches(trim(line), '^(?i)(def |function |func |fn |sub |class |struct |interface )') then 1 else 0 end) over (partition by doc_id order by i) block from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null)) group by 1, 2 having length(string_agg(line, chr(10) order by i)) >= 50")
def boundary_chunks(spark, d):
    from treadle.functions.chunking import boundary_blocks

    return boundary_blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query()
def size_chunks_overlap(spark, d):
    from treadle.functions.chunking import size_blocks

    return size_blocks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
