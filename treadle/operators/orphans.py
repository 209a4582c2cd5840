"""References to records that do not exist.

Records refer to other records by key; the other record may never have been
loaded, may come later, or may be deleted by the end of the period the
reference belongs to. Distinct non-null references are anti-joined with the
intervals in which their targets are live, and the result is joined back to
the referring rows for the report per field and period.

Periods are months. ``E`` of a row is the first instant of the month after its
``indexed_at``; month instants are numbered ``year * 12 + month``, so that a
target is live at exactly the instants from ``month(indexed_at) + 1`` to
``month(deleted_at)``: the range becomes a residual of an equi join.

Defined results: null or empty references, null ``repo``, null ``indexed_at``
and null elements refer to nothing and are no cases; rows delivered twice and
equal references of one row count once; empty tables give an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions.paths import folded_path, parent_dir
from treadle.session import absent, cut, table

#: A month after every possible one, the end of what is never deleted.
FOREVER = 12 * 100_000

JS_EXTENSIONS = ("", ".js", ".jsx", ".ts", ".tsx")


def month_no(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def month_start(no: Column) -> Column:
    """``yyyy-mm`` of a month number."""
    return F.format_string("%04d-%02d", ((no - 1) / 12).cast("int"), ((no - 1) % 12 + 1).cast("int"))


def live_spans(chunks: DataFrame, deletes: DataFrame) -> DataFrame:
    """Chunks with ``e_first``/``e_last``, the month instants at which they are live."""
    gone = (
        deletes.where("repo is not null and id is not null and deleted_at is not null")
        .groupBy("repo", "id")
        .agg(F.min("deleted_at").alias("_gone"))
    )
    return (
        chunks.where("repo is not null and indexed_at is not null")
        .join(gone, ["repo", "id"], "left")
        .withColumn("e_first", month_no(F.col("indexed_at")) + 1)
        .withColumn("e_last", F.coalesce(month_no(F.col("_gone")), F.lit(FOREVER)))
        .drop("_gone")
        .where("e_first <= e_last")
    )


def unanswered(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct ``refs(repo, key, e)`` that no ``targets(repo, key, e_first, e_last)`` answers."""
    r, t = refs.alias("r"), targets.alias("t")
    hit = (F.col("r.repo") == F.col("t.repo")) & (F.col("r.key") == F.col("t.key"))
    return r.join(t, hit & F.col("r.e").between(F.col("t.e_first"), F.col("t.e_last")), "left_anti")


def _targets(live: DataFrame, key: Column) -> DataFrame:
    return live.select("repo", key.alias("key"), "e_first", "e_last").where("key is not null").distinct()


def prefixes(path: Column) -> Column:
    """``path`` and its prefixes that end before a ``.`` or ``/``."""
    ends = F.filter(
        F.sequence(F.lit(1), F.length(path)),
        lambda i: (i == F.length(path)) | F.substring(path, i + 1, 1).isin(".", "/"),
    )
    return F.when(F.length(path) > 0, F.transform(ends, lambda i: F.substring(path, F.lit(1), i)))


def import_candidates(language: Column, from_path: Column, file: Column, module: Column) -> Column:
    """Keys of which one has to be live: ``f:`` and a file, or ``d:`` and a directory of Go files."""
    slashed = F.translate(from_path, ".", "/")
    python = F.when(
        from_path.contains("."),
        F.array(F.concat(F.lit("f:"), slashed, F.lit(".py")), F.concat(F.lit("f:"), parent_dir(slashed), F.lit(".py"))),
    ).otherwise(F.array(F.concat(F.lit("f:"), slashed, F.lit(".py"))))
    java = F.array(F.concat(F.lit("f:src/main/java/"), slashed, F.lit(".java")))
    inside = F.concat(module, F.lit("/"))
    go = F.when(
        from_path.startswith(inside),
        F.array(F.concat(F.lit("d:"), F.expr("substring(from_path, length(module) + 2)"))),
    )
    base = folded_path(F.concat_ws("/", F.nullif(parent_dir(file), F.lit("")), from_path))
    js = F.array(*[F.concat(F.lit("f:"), base, F.lit(x)) for x in JS_EXTENSIONS])
    return (
        F.when(language == "python", python)
        .when(language == "java", java)
        .when(language == "go", F.coalesce(go, F.array(F.lit("none"))))
        .when(language.isin("javascript", "typescript"), js)
    )


def orphan_references(chunks: DataFrame, deletes: DataFrame, go_mod: DataFrame, externals: DataFrame) -> DataFrame:
    """``(ref_field, chunk_no, ref_key, e)`` of every reference that nothing live at ``e`` answers."""
    return _references(chunks, deletes, go_mod, externals)[1]


def _references(chunks, deletes, go_mod, externals):
    """All references ``(ref_field, chunk_no, ref_key, e)``, and those that are orphans."""
    # every part below starts from these rows; without the cut each would join and move them again
    live = cut(
        live_spans(
            chunks.select("chunk_no", "repo", "id", "name", "file", "language", "calls", "imports_map", "parent", "indexed_at"),
            deletes,
        ).drop("indexed_at")
    )
    known = externals.select("language", "kind", "symbol").where("symbol is not null and language is not null").distinct()
    refer = live.withColumn("e", F.col("e_first"))

    # calls: the distinct names of a chunk, without those from outside
    outside = known.where("kind = 'call'").select("language", F.col("symbol").alias("key"))
    calls = (
        refer.select("chunk_no", "repo", "language", "e", F.explode(F.array_distinct("calls")).alias("key"))
        .where("key is not null and key <> ''")
        .join(outside, ["language", "key"], "left_anti")
        .select("repo", "key", "e", "chunk_no")
    )
    parents = refer.select("repo", absent(F.col("parent")).alias("key"), "e", "chunk_no").where("key is not null")

    lost_calls = unanswered(calls.select("repo", "key", "e").distinct(), _targets(live, absent(F.col("name"))))
    lost_parents = unanswered(parents.select("repo", "key", "e").distinct(), _targets(live, absent(F.col("id"))))

    # imports: a reference has several candidate keys, of which one must be live
    packages = known.where("kind = 'package'").select("language", F.col("symbol").alias("prefix"))
    imports = (
        refer.select("chunk_no", "repo", "language", "file", "e", F.explode(F.map_values("imports_map")).alias("i"))
        .select("chunk_no", "repo", "language", "file", "e", F.col("i.from_path").alias("from_path"))
        .where("from_path is not null and from_path <> ''")
        .withColumn("at", F.when(F.col("language").isin("javascript", "typescript"), parent_dir(F.coalesce("file", F.lit("")))).otherwise(""))
    )
    paths = imports.select("language", "from_path").distinct()
    external = (
        paths.select("language", "from_path", F.explode(prefixes(F.col("from_path"))).alias("prefix"))
        .join(packages, ["language", "prefix"], "left_semi")
        .select("language", "from_path")
        .distinct()
    )
    inner = imports.join(external, ["language", "from_path"], "left_anti")
    wanted = ["repo", "language", "from_path", "at", "e"]
    modules = go_mod.where("repo is not null").groupBy("repo").agg(F.min(absent(F.col("module"))).alias("module"))
    keys = inner.select(*wanted).distinct()
    at_file = F.concat(F.col("at"), F.lit("/_"))
    candidates = (
        keys.join(modules, "repo", "left")
        .withColumn("keys", import_candidates(F.col("language"), F.col("from_path"), F.when(F.col("at") != "", at_file).otherwise("_"), F.col("module")))
        .where("keys is not null")
    )
    files = _targets(live, F.concat(F.lit("f:"), absent(F.col("file"))))
    go_dirs = _targets(live.where(F.col("file").endswith(".go") & F.col("file").contains("/")), F.concat(F.lit("d:"), parent_dir(F.col("file"))))
    c, t = candidates.select(*wanted, F.explode("keys").alias("key")).alias("c"), files.unionByName(go_dirs).alias("t")
    answered = (
        c.join(t, (F.col("c.repo") == F.col("t.repo")) & (F.col("c.key") == F.col("t.key")) & F.col("c.e").between(F.col("t.e_first"), F.col("t.e_last")), "left_semi")
        .select(*wanted)
        .distinct()
    )
    lost_imports = candidates.select(*wanted).join(answered, wanted, "left_anti")

    def back(refs: DataFrame, lost: DataFrame, field: str) -> DataFrame:
        return refs.join(lost, ["repo", "key", "e"], "left_semi").select(F.lit(field).alias("ref_field"), "chunk_no", F.col("key").alias("ref_key"), "e").distinct()

    orphans = (
        back(calls, lost_calls, "calls")
        .unionByName(back(parents, lost_parents, "parent"))
        .unionByName(
            inner.join(lost_imports, wanted, "left_semi")
            .select(F.lit("imports_map").alias("ref_field"), "chunk_no", F.col("from_path").alias("ref_key"), "e")
            .distinct()
        )
    )
    every = (
        calls.select(F.lit("calls").alias("ref_field"), "chunk_no", F.col("key").alias("ref_key"), "e")
        .unionByName(parents.select(F.lit("parent").alias("ref_field"), "chunk_no", F.col("key").alias("ref_key"), "e"))
        .unionByName(inner.select(F.lit("imports_map").alias("ref_field"), "chunk_no", F.col("from_path").alias("ref_key"), "e"))
    )
    return every, orphans


def orphan_report(chunks: DataFrame, deletes: DataFrame, go_mod: DataFrame, externals: DataFrame) -> DataFrame:
    """References and orphans per field and month of ``indexed_at``; outside names are not counted."""
    every, orphans = _references(chunks, deletes, go_mod, externals)
    marked = every.select("ref_field", "chunk_no", "ref_key", "e", F.lit(0).alias("o")).unionByName(orphans.withColumn("o", F.lit(1)))
    return (
        marked.groupBy("ref_field", "chunk_no", "ref_key", "e")
        .agg(F.max("o").alias("o"))
        .groupBy("ref_field", month_start(F.col("e") - 1).alias("month"))
        .agg(F.count("*").alias("n_refs"), F.sum("o").cast("long").alias("n_orphans"))
        .withColumn("share", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
    )


def _tables(spark: SparkSession, d: str):
    return (table(spark, d, n) for n in ("chunks", "chunk_deletes", "go_mod", "externals"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*_tables(spark, d)).select("ref_field", "chunk_no", "ref_key")


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_tables(spark, d))


_SQL_REFS = """
with one as (select distinct chunk_no, repo, id, name, file, language, calls, imports_map, parent, indexed_at from chunks
             where repo is not null and indexed_at is not null),
gone as (select repo, id, min(deleted_at) g from chunk_deletes where deleted_at is not null group by all),
live as (select o.*, year(indexed_at)*12+month(indexed_at)+1 e_first, coalesce(year(g)*12+month(g), 1200000) e_last
         from one o left join gone using (repo, id)),
ok as (select * from live where e_first <= e_last),
mods as (select repo, min(nullif(module,'')) module from go_mod group by repo),
c0 as (select distinct chunk_no, repo, language, e_first e, unnest(calls) k from ok),
calls1 as (select * from c0 where k is not null and k <> '' and not exists
    (select 1 from externals x where x.kind='call' and x.language=c0.language and x.symbol=c0.k)),
parents1 as (select distinct chunk_no, repo, e_first e, parent k from ok where parent is not null and parent <> ''),
i0 as (select distinct chunk_no, repo, language, file, e_first e, unnest(map_values(imports_map)).from_path k from ok),
imports1 as (select * from i0 where k is not null and k <> '' and not exists
    (select 1 from externals x where x.kind='package' and x.language=i0.language
      and (i0.k = x.symbol or starts_with(i0.k, x.symbol || '.') or starts_with(i0.k, x.symbol || '/')))),
parts as (select *, list_filter(string_split(case when contains(file,'/') then regexp_replace(file,'/[^/]*$','') || '/' || k else k end, '/'),
    lambda s: s <> '' and s <> '.') p from imports1 where language in ('javascript','typescript')),
norm as (select * exclude (p), case when len(p) = 0 then '' else array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(p, lambda s: [s])),
    lambda a, s: case when s[1] = '..' then a[1:len(a)-1] else list_concat(a, s) end), '/') end path from parts),
cand as (
  select chunk_no, repo, k, e, unnest(case when contains(k,'.') then [replace(k,'.','/') || '.py', regexp_replace(replace(k,'.','/'),'/[^/]*$','') || '.py'] else [k || '.py'] end) f
    from imports1 where language='python'
  union all select chunk_no, repo, k, e, 'src/main/java/' || replace(k,'.','/') || '.java' from imports1 where language='java'
  union all select chunk_no, repo, k, e, unnest([path, path || '.js', path || '.jsx', path || '.ts', path || '.tsx']) from norm),
gocand as (select i.chunk_no, i.repo, i.k, i.e, case when starts_with(i.k, m.module || '/') then substr(i.k, length(m.module)+2) end dir
    from imports1 i left join mods m using (repo) where language='go'),
files as (select distinct repo, file, e_first, e_last from ok),
found_imports as (
  select chunk_no, k from cand c group by chunk_no, k having not bool_or(exists
     (select 1 from files f where f.repo=c.repo and f.file=c.f and c.e between f.e_first and f.e_last))
  union all select distinct chunk_no, k from gocand c where not exists
     (select 1 from files f where f.repo=c.repo and f.file like '%.go' and f.file like '%/%'
        and regexp_replace(f.file,'/[^/]*$','') = c.dir and c.e between f.e_first and f.e_last)),
orphans as (
select 'calls' ref_field, chunk_no, k ref_key, e from calls1 c where not exists
   (select 1 from ok t where t.repo=c.repo and t.name=c.k and c.e between t.e_first and t.e_last)
union all select 'parent', chunk_no, k, e from parents1 c where not exists
   (select 1 from ok t where t.repo=c.repo and t.id=c.k and c.e between t.e_first and t.e_last)
union all select distinct 'imports_map', chunk_no, k, e from found_imports join (select distinct chunk_no, k, e from imports1) using (chunk_no, k))
"""

SQL = {
    "p1_found": _SQL_REFS + "select distinct ref_field, chunk_no, ref_key from orphans",
    "p1_orphan_report": _SQL_REFS
    + """, every as (select 'calls' ref_field, chunk_no, k ref_key, e from calls1
  union select 'parent', chunk_no, k, e from parents1 union select 'imports_map', chunk_no, k, e from imports1)
select ref_field, printf('%04d-%02d', (e-2)//12, (e-2)%12+1) "month", count(*) n_refs, count(o.e)::bigint n_orphans,
  round(count(o.e)/count(*), 6) share
from every left join (select distinct * from orphans) o using (ref_field, chunk_no, ref_key, e) group by 1, 2""",
}

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report}
