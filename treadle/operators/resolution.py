"""Calls and imports resolved to the chunks they mean.

Definitions are reduced to one row per key before they are joined (the first
and second of a file and name, the first member of a class, the last of a
package), so that no join multiplies callers by definitions of one name. An
imported path is resolved once per repository, language, directory and path.

Calls outside Go are resolved by the first of these rules that gives a chunk:
the imported receiver type's member, the imported name, another chunk of that
name in the same file. Go calls with a receiver of unknown type are left out;
the others go through the receiver's type, the package alias or the import's
directory, then through the caller's package.

Defined results: rows delivered twice count once; of several chunks in question
the first by file, line and id counts, for a package's symbol the last; null and
empty receivers, types and packages are absent; null maps and arrays are empty;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.functions import paths, text
from treadle.operators.graph import _N, nodes
from treadle.session import absent, cut, table

# File endings that are tried per language.
EXTENSIONS = {
    "python": [".py", "/__init__.py"],
    "javascript": [".js", ".jsx", "/index.js"],
    "typescript": [".ts", ".tsx", "/index.ts", ".js", "/index.js"],
    "java": [".java"],
}

#: Where the files of a package path lie, and whether the last part of a path may name a member of its file.
ROOTS, MEMBERS = ("",), False

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def base_path(language: Column, directory: Column, path: Column) -> Column:
    """The path without ending that an import names; null where it leads out of the repository."""
    return F.nullif(
        F.when(language == "python", paths.python_module_path(path, directory))
        .when(language.isin("javascript", "typescript"), F.when(path.startswith("."), paths.folded_path(F.concat(directory, F.lit("/"), path))))
        .when(language == "java", text.java_import_path(path)),
        F.lit(""),
    )


def import_files(n: DataFrame, roots=ROOTS, members: bool = MEMBERS) -> DataFrame:
    """``(repo, language, dir, from_path, src)``: the file each imported path of a directory means, the first candidate that exists."""
    i = n.where("language <> 'go'").select("repo", "language", paths.parent_dir(F.col("file")).alias("dir"), F.explode(F.map_values("imports_map")).alias("i"))
    i = i.select("repo", "language", "dir", F.col("i.from_path").alias("from_path")).where("from_path <> ''").distinct()
    i = i.withColumn("base", base_path(F.col("language"), F.col("dir"), F.col("from_path"))).where("base is not null")
    bases = [F.col("base")] + ([F.when(F.col("base").contains("/"), F.regexp_replace("base", "/[^/]*$", ""))] if members else [])
    tried = F.lit(None)
    for language, endings in EXTENSIONS.items():
        tried = F.when(F.col("language") == language, F.array(*(F.regexp_replace(F.concat(F.lit(r), b, F.lit(e)), "^/+", "") for b in bases for r in roots for e in endings))).otherwise(tried)
    c = i.select("repo", "language", "dir", "from_path", F.posexplode(tried).alias("at", "src")).where("src is not null")
    known = n.select("repo", F.col("file").alias("src")).where("src is not null").distinct()
    return c.join(known, ["repo", "src"], "left_semi").groupBy("repo", "language", "dir", "from_path").agg(F.min_by("src", "at").alias("src"))


_ORDER = ["file", "start_line", "id"]


def _first(n: DataFrame, keys: list[str], order: list[str] = _ORDER, last: bool = False) -> DataFrame:
    pick = F.max if last else F.min
    # nulls first in both engines: absent lines count as zero
    at = F.struct(*(F.coalesce("start_line", F.lit(0)).alias("start_line") if c == "start_line" else F.col(c) for c in order))
    return n.groupBy(*keys).agg(pick(at)["id"].alias("target"))


def _calls(n: DataFrame) -> DataFrame:
    x = n.select("repo", "id", "file", "language", "imports_map", F.explode(F.array_distinct("calls_with_context")).alias("c"))
    return x.select("repo", "id", "file", "language", "imports_map", F.col("c.name").alias("call"), absent(F.col("c.receiver")).alias("receiver"), absent(F.col("c.receiver_type")).alias("kind"), F.coalesce("c.resolved", F.lit(False)).alias("resolved")).where("call is not null")


def resolve_general(n: DataFrame, roots=ROOTS, members: bool = MEMBERS) -> DataFrame:
    """``(repo, id, call, target, rule)`` of the calls outside Go that a rule resolves."""
    found = lambda name: F.try_element_at("imports_map", F.col(name))["from_path"]
    k = _calls(n.where("language <> 'go'")).withColumn("dir", paths.parent_dir(F.col("file"))).withColumn("from_kind", found("kind")).withColumn("from_name", found("call")).drop("imports_map")
    files = cut(import_files(n, roots, members))
    by = lambda way: files.select("repo", "language", "dir", F.col("from_path").alias(f"from_{way}"), F.col("src").alias(f"src_{way}"))
    for way in ("kind", "name"):
        k = k.join(by(way), ["repo", "language", "dir", f"from_{way}"], "left")
    owner = n.select("repo", F.col("id").alias("parent"), F.col("name").alias("kind"), F.col("file").alias("src_kind"), F.coalesce("start_line", F.lit(0)).alias("p_line"))
    member = n.select("repo", "parent", F.col("file").alias("src_kind"), F.col("name").alias("call"), "id", F.coalesce("start_line", F.lit(0)).alias("line"))
    m = member.join(owner, ["repo", "parent", "src_kind"]).groupBy("repo", "src_kind", "kind", "call").agg(F.min(F.struct("p_line", "parent", "line", "id"))["id"].alias("by_member"))
    defs = n.where("file is not null and name is not null").select("repo", "file", F.col("name").alias("call"), F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), "id").alias("at"))
    two = defs.withColumn("r", F.row_number().over(Window.partitionBy("repo", "file", "call").orderBy("at"))).where("r <= 2")
    two = two.groupBy("repo", "file", "call").agg(F.min("at")["id"].alias("first"), F.max(F.when(F.col("r") == 2, F.col("at")))["id"].alias("second"))
    j = (
        k.join(m, ["repo", "src_kind", "kind", "call"], "left")
        .join(two.select("repo", F.col("file").alias("src_name"), "call", F.col("first").alias("by_name")), ["repo", "src_name", "call"], "left")
        .join(two, ["repo", "file", "call"], "left")
    )
    here = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    rule = F.when(F.col("by_member").isNotNull(), 1).when(F.col("by_name").isNotNull(), 2).otherwise(3)
    return j.select("repo", "id", "call", F.coalesce("by_member", "by_name", here).alias("target"), rule.alias("rule")).where("target is not null")


def go_packages(n: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Go chunks with their file's package, each file's imports, each directory's package, each repository's module."""
    go = n.where("language = 'go' and file is not null")
    files = go.groupBy("repo", "file").agg(
        F.max(absent(F.col("package_name"))).alias("pkg"),
        F.min_by("imports_map", F.struct(F.coalesce("start_line", F.lit(0)), F.col("id"))).alias("aliases"),
        F.min_by("imports_map", F.when(F.size("imports_map") > 0, F.struct(F.coalesce("start_line", F.lit(0)), F.col("id")))).alias("imports"),
    )
    named = files.where("pkg is not null")
    return {
        "files": files,
        "chunks": go.join(named.select("repo", "file", "pkg"), ["repo", "file"]),
        "dirs": named.groupBy("repo", paths.parent_dir(F.col("file")).alias("dir")).agg(F.max_by("pkg", "file").alias("dir_pkg")),
        "modules": modules.groupBy("repo").agg(F.min(absent(F.col("module"))).alias("module")),
    }


def go_dir(module: Column, path: Column) -> Column:
    """The directory an internal import names; null for others."""
    inside = F.regexp_replace(F.substring(path, F.length(module) + 1, F.length(path)), "^/+", "")
    outer = F.when(path.contains("/") & ~_starts(path, text.GO_EXTERNAL_HOSTS), F.regexp_replace(path, "^[^/]*/", ""))
    return F.when(module.isNull(), outer).when(path.startswith(module), F.when(inside == "", ".").otherwise(inside))


def resolve_go(n: DataFrame, modules: DataFrame) -> DataFrame:
    """``(repo, id, call, target, rule)`` of the Go calls that resolve; rules 1 to 3 as type, alias, package."""
    g = go_packages(n, modules)
    c = g["chunks"].select("repo", "pkg", F.col("name").alias("call"), F.substring_index(F.coalesce("parent", F.lit("")), "::", -1).alias("owner"), *_ORDER).where("call is not null")
    symbol = _first(c, ["repo", "pkg", "call"], last=True)
    within = _first(c, ["repo", "pkg", "call"])
    owned = _first(c.where("owner <> ''"), ["repo", "pkg", "call", "owner"])

    k = _calls(n.where("language = 'go'")).drop("imports_map").where("receiver is null or resolved")
    k = k.join(g["files"], ["repo", "file"], "left").join(g["modules"], "repo", "left")
    bare = F.regexp_replace(F.ltrim("kind"), r"^(?:\*|\[\d*\])+", "")
    k = k.withColumn("bare", bare).withColumn("qualified", F.coalesce(F.col("bare").contains("."), F.lit(False)))
    alias = F.when(F.col("qualified"), F.substring_index("bare", ".", 1)).when(F.col("kind").isNull(), F.col("receiver"))
    k = k.withColumn("alias", alias)
    k = k.withColumn("pkg1", F.coalesce(F.substring_index(F.try_element_at("aliases", F.col("alias"))["from_path"], "/", -1), F.col("alias")))
    k = k.withColumn("dir", go_dir(F.col("module"), F.try_element_at("imports", F.col("alias"))["from_path"])).drop("aliases", "imports")
    k = k.join(g["dirs"], ["repo", "dir"], "left")
    to = lambda t, pkg, name: t.select("repo", F.col("pkg").alias(pkg), "call", F.col("target").alias(name))
    j = (
        k.join(to(symbol, "pkg1", "by_alias"), ["repo", "pkg1", "call"], "left")
        .join(to(symbol, "dir_pkg", "by_dir"), ["repo", "dir_pkg", "call"], "left")
        .join(owned.select("repo", "pkg", "call", F.col("owner").alias("bare"), F.col("target").alias("by_owner")), ["repo", "pkg", "call", "bare"], "left")
        .join(to(within, "pkg", "by_pkg"), ["repo", "pkg", "call"], "left")
    )
    through = F.coalesce("by_alias", "by_dir")
    target = F.when(F.col("qualified"), through).when(F.col("kind").isNotNull(), F.coalesce("by_owner", "by_pkg")).otherwise(F.coalesce(through, F.col("by_pkg")))
    rule = F.when(F.col("kind").isNotNull(), 1).when(through.isNotNull(), 2).otherwise(3)
    return j.select("repo", "id", "call", target.alias("target"), rule.alias("rule")).where("target is not null")


def resolve_calls(n: DataFrame, modules: DataFrame, roots=ROOTS, members: bool = MEMBERS) -> DataFrame:
    """``(repo, id, call, target, rule)``: each call edge once, with the first rule that gives it."""
    both = resolve_general(n, roots, members).unionByName(resolve_go(n, modules))
    return both.groupBy("repo", "id", "call", "target").agg(F.min("rule").alias("rule"))


def resolve_imports(n: DataFrame, modules: DataFrame, roots=ROOTS, members: bool = MEMBERS) -> DataFrame:
    """``(repo, src, dst, attr)``: each import edge once; ``attr`` is the path."""
    i = n.select("repo", F.col("id").alias("src"), "language", paths.parent_dir(F.col("file")).alias("dir"), F.explode(F.map_entries("imports_map")).alias("e"))
    i = i.select("repo", "src", "language", "dir", F.col("e.key").alias("name"), F.col("e.value.from_path").alias("from_path")).where("from_path <> ''")
    t = n.select("repo", "file", "name", F.col("id").alias("dst"))
    files = import_files(n, roots, members).withColumnRenamed("src", "file")
    general = i.where("language <> 'go'").join(files, ["repo", "language", "dir", "from_path"]).join(t, ["repo", "file", "name"]).select("repo", "src", "dst", F.col("from_path").alias("attr"))
    g = go_packages(n, modules)
    kinds = g["chunks"].where("chunk_type in ('struct', 'interface', 'function')").select("repo", F.col("pkg").alias("dir_pkg"), F.col("id").alias("dst"))
    go = i.where("language = 'go'").select("repo", "src", "from_path").distinct().join(g["modules"], "repo", "left").withColumn("dir", go_dir(F.col("module"), F.col("from_path")))
    go = go.join(g["dirs"], ["repo", "dir"]).join(kinds, ["repo", "dir_pkg"]).select("repo", "src", "dst", F.col("from_path").alias("attr"))
    return general.unionByName(go).distinct()


def _all(spark, d) -> DataFrame:
    """Each chunk once; written, because every rule reads other columns of it."""
    return cut(nodes(spark, d, "name", "file", "language", "start_line", "parent", "package_name", "chunk_type", "imports_map", "calls_with_context"))


def _sql(roots: tuple[str, ...] = ROOTS, members: bool = MEMBERS) -> str:
    """The shared part of the SQL: chunks, calls, imported files and Go packages."""
    tries = []
    for language, endings in EXTENSIONS.items():
        for i, (b, r, e) in enumerate((b, r, e) for b in (("base", "case when contains(base, '/') then regexp_replace(base, '/[^/]*$', '') end") if members else ("base",)) for r in roots for e in endings):
            tries.append(f"select *, {i} as pos, ltrim('{r}' || {b} || '{e}', '/') src from based where language = '{language}'")
    hosts = " or ".join(f"starts_with(from_path, '{h}')" for h in text.GO_EXTERNAL_HOSTS)
    java = " or ".join(f"starts_with(from_path, '{h}')" for h in text.JAVA_EXTERNAL)
    dots = "length(regexp_extract(from_path, '^\\.*'))"
    rest = "replace(regexp_replace(from_path, '^\\.+', ''), '.', '/')"
    return rf"""
with recursive n as (select repo, id, name, file, language, coalesce(start_line, 0) line, nullif(parent, '') parent, nullif(package_name, '') package_name, chunk_type, imports_map, calls_with_context,
    case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '' end dir from {_N}),
imp as (select repo, id, file, language, dir, line, unnest(map_keys(imports_map)) alias, unnest(map_values(imports_map)).from_path from_path from n),
paths as (select distinct repo, language, dir, from_path from imp where from_path <> '' and language <> 'go'),
fold as (select repo, language, dir, from_path, string_split(dir || '/' || from_path, '/') s, 1 k, []::varchar[] p from paths where language in ('javascript', 'typescript') and starts_with(from_path, '.')
  union all select repo, language, dir, from_path, s, k + 1, case when s[k] in ('', '.') then p when s[k] = '..' then p[1:len(p) - 1] else list_append(p, s[k]) end from fold where k <= len(s)),
based as (select * from (
  select repo, language, dir, from_path, case when {dots} = 0 then replace(from_path, '.', '/')
    else concat_ws('/', nullif(array_to_string((string_split(dir, '/'))[1:greatest(len(string_split(dir, '/')) - {dots} + 1, 0)], '/'), ''), nullif({rest}, '')) end base from paths where language = 'python'
  union all select repo, language, dir, from_path, array_to_string(p, '/') from fold where k = len(s) + 1
  union all select repo, language, dir, from_path, replace(from_path, '.', '/') from paths where language = 'java' and not ends_with(from_path, '.*') and not ({java})) where base <> ''),
tried as ({" union all ".join(tries)}),
found as (select repo, language, dir, from_path, arg_min(src, pos) src from tried where src is not null and (repo, src) in (select repo, file from n) group by all),
calls as (select distinct repo, id, file, language, dir, c.name as call_name, nullif(c.receiver, '') receiver, nullif(c.receiver_type, '') kind, coalesce(c.resolved, false) resolved
  from (select repo, id, file, language, dir, unnest(calls_with_context) c from n) where c.name is not null),
gofile as (select repo, file, any_value(dir) dir, max(package_name) pkg, arg_min(id, (line, id)) first, arg_min(id, (line, id)) filter (where cardinality(imports_map) > 0) holder from n where language = 'go' group by 1, 2),
dirs as (select repo, dir, arg_max(pkg, file) dir_pkg from gofile where pkg is not null group by 1, 2),
mods as (select repo, min(nullif(module, '')) module from go_mod group by 1),
goimp as (select i.*, case when m.module is null then case when contains(from_path, '/') and not ({hosts}) then regexp_replace(from_path, '^[^/]*/', '') end
   when starts_with(from_path, m.module) then coalesce(nullif(ltrim(substr(from_path, length(m.module) + 1), '/'), ''), '.') end to_dir
  from imp i left join mods m using (repo) where language = 'go'),
gochunk as (select n.*, g.pkg from n join gofile g on n.repo = g.repo and n.file = g.file where n.language = 'go' and g.pkg is not null)
"""


_SQL_CALLS = r"""
, general as (
 select k.repo, k.id, k.call_name, m.id target, 1 rule, [c.line::varchar.lpad(9, '0'), c.id, m.line::varchar.lpad(9, '0'), m.id] o from calls k join imp i on i.repo = k.repo and i.id = k.id and i.alias = k.kind
   join found f on f.repo = k.repo and f.language = k.language and f.dir = k.dir and f.from_path = i.from_path
   join n c on c.repo = k.repo and c.file = f.src and c.name = k.kind join n m on m.repo = k.repo and m.file = f.src and m.name = k.call_name and m.parent = c.id where k.language <> 'go'
 union all select k.repo, k.id, k.call_name, t.id, 2, [t.line::varchar.lpad(9, '0'), t.id] from calls k join imp i on i.repo = k.repo and i.id = k.id and i.alias = k.call_name
   join found f on f.repo = k.repo and f.language = k.language and f.dir = k.dir and f.from_path = i.from_path join n t on t.repo = k.repo and t.file = f.src and t.name = k.call_name where k.language <> 'go'
 union all select k.repo, k.id, k.call_name, t.id, 3, [t.line::varchar.lpad(9, '0'), t.id] from calls k join n t on t.repo = k.repo and t.file = k.file and t.name = k.call_name and t.id <> k.id where k.language <> 'go'),
-- a call counts with its receiver type, as the rules depend on it
per as (select k.repo, k.id, k.call_name, k.receiver, k.kind, g.target, g.rule from calls k join lateral (
   select target, rule from general g where g.repo = k.repo and g.id = k.id and g.call_name = k.call_name and (g.rule > 1 or exists (
     select 1 from n t join n c on c.repo = t.repo and c.id = t.parent and c.file = t.file where t.repo = g.repo and t.id = g.target and c.name = k.kind)) order by rule, o limit 1) g on true where k.language <> 'go'),
gc as (select k.*, g.pkg, g.first, g.holder, regexp_replace(ltrim(k.kind), '^(\*|\[[0-9]*\])+', '') bare from calls k join gofile g on g.repo = k.repo and g.file = k.file where k.language = 'go' and (k.receiver is null or k.resolved)),
ga as (select *, coalesce(contains(bare, '.'), false) qualified, case when contains(bare, '.') then split_part(bare, '.', 1) when kind is null then receiver end alias from gc),
gp as (select ga.*, coalesce((select string_split(i.from_path, '/')[-1] from goimp i where i.repo = ga.repo and i.id = ga.first and i.alias = ga.alias), ga.alias) pkg1,
  (select d.dir_pkg from goimp i join dirs d on d.repo = i.repo and d.dir = i.to_dir where i.repo = ga.repo and i.id = ga.holder and i.alias = ga.alias) pkg2 from ga),
symbol as (select repo, pkg, name, arg_max(id, (file, line, id)) last, arg_min(id, (file, line, id)) first from gochunk group by all),
owned as (select repo, pkg, name, string_split(parent, '::')[-1] owner, arg_min(id, (file, line, id)) first from gochunk where parent is not null group by all),
gr as (select gp.repo, gp.id, gp.call_name, case when kind is not null then 1 when coalesce(a.last, b.last) is not null then 2 else 3 end rule,
  case when qualified then coalesce(a.last, b.last) when kind is not null then coalesce(o.first, s.first) else coalesce(a.last, b.last, s.first) end target
 from gp left join symbol a on a.repo = gp.repo and a.pkg = gp.pkg1 and a.name = gp.call_name left join symbol b on b.repo = gp.repo and b.pkg = gp.pkg2 and b.name = gp.call_name
 left join symbol s on s.repo = gp.repo and s.pkg = gp.pkg and s.name = gp.call_name left join owned o on o.repo = gp.repo and o.pkg = gp.pkg and o.name = gp.call_name and o.owner = gp.bare)
select repo, id, call_name as "call", target, min(rule)::int as rule from (select repo, id, call_name, target, rule from per union all select repo, id, call_name, target, rule from gr where target is not null) group by 1, 2, 3, 4
"""

_SQL_IMPORTS = """
select distinct i.repo, i.id src, t.id dst, i.from_path attr from imp i join found f on f.repo = i.repo and f.language = i.language and f.dir = i.dir and f.from_path = i.from_path
 join n t on t.repo = i.repo and t.file = f.src and t.name = i.alias where i.language <> 'go'
union select i.repo, i.id, t.id, i.from_path from goimp i join dirs d on d.repo = i.repo and d.dir = i.to_dir join gochunk t on t.repo = i.repo and t.pkg = d.dir_pkg and t.chunk_type in ('struct', 'interface', 'function')
"""

#: Java packages below a source root, and paths that name a member of their file.
ROOTED = {"roots": ("", "src/main/java/"), "members": True}


@query(_sql() + _SQL_CALLS)
def call_resolution_ranked(spark, d):
    return resolve_calls(_all(spark, d), table(spark, d, "go_mod"))


@query(_sql(**ROOTED) + _SQL_CALLS)
def call_resolution_rooted(spark, d):
    """With source roots and paths that name members."""
    return resolve_calls(_all(spark, d), table(spark, d, "go_mod"), **ROOTED)


@query(_sql() + _SQL_IMPORTS)
def import_edges_resolved(spark, d):
    return resolve_imports(_all(spark, d), table(spark, d, "go_mod"))


@query(_sql(**ROOTED) + _SQL_IMPORTS)
def import_edges_rooted(spark, d):
    return resolve_imports(_all(spark, d), table(spark, d, "go_mod"), **ROOTED)


@query(_sql() + "select * from found")
def extension_probe(spark, d):
    """The first of a path's candidate files that exists, in every language."""
    return import_files(_all(spark, d))
