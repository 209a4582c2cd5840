"""Joins, rollups and traversals over chunks and edges.

Every limit has a total order. Neighbourhoods are joins; capped lists are ranked
in windows with a group limit, which Spark applies before the shuffle. The two
order-dependent traversals run all starts together, one join per level, and are
cut in the shared folder between levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treadle.functions import text
from treadle.session import cut, table

CALLERS, SIBLINGS, FILE_LINKS, PACKAGE_LINKS, FLOW_STEPS, FAN_OUT = 6, 5, 10, 10, 10, 5

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return table(spark, d, "chunks").select("repo", "id", *cols).dropDuplicates(["repo", "id"])


def edges(spark: SparkSession, d: str, *rels: str) -> DataFrame:
    """Distinct ``(repo, src, dst, rel)``."""
    e = table(spark, d, "edges").select("repo", "src", "dst", "rel")
    return (e.where(F.col("rel").isin(*rels)) if rels else e).distinct()


def ranked(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


_N = "(select distinct on (repo, id) * from chunks)"
_E = "(select distinct repo, src, dst, rel from edges)"


@query(f"select distinct repo, file as src, id as dst from {_N} where file is not null")
def contains_edges(spark, d):
    files = table(spark, d, "chunks").select("repo", "file").where("file is not null").distinct()
    return files.join(nodes(spark, d, "file"), ["repo", "file"]).select("repo", F.col("file").alias("src"), F.col("id").alias("dst"))


@query(f"select c.repo, p.id as src, c.id as dst from {_N} c join {_N} p on c.repo = p.repo and c.parent = p.id")
def has_member_self_join(spark, d):
    c = nodes(spark, d, "parent").where("parent <> ''").select("repo", F.col("parent").alias("src"), F.col("id").alias("dst"))
    return c.join(nodes(spark, d).withColumnRenamed("id", "src"), ["repo", "src"], "left_semi")


@query(f"select c.repo, c.id, p.id as parent_id, p.name as parent_name from {_N} c left join {_N} p on c.repo = p.repo and c.parent = p.id")
def parent_lookup(spark, d):
    p = nodes(spark, d, "name").select("repo", F.col("id").alias("parent"), F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return nodes(spark, d, "parent").join(p, ["repo", "parent"], "left").select("repo", "id", "parent_id", "parent_name")


_CAP = "select repo, {k} as id, {o} as other, rank from (select e.repo, e.src, e.dst, (row_number() over (partition by e.repo, e.{k} order by e.{o}))::int rank from {e} e where rel = 'CALLS') where rank <= {n}"


@query(_CAP.format(k="dst", o="src", e=_E, n=CALLERS))
def callers_capped(spark, d):
    return ranked(edges(spark, d, "CALLS"), ["repo", "dst"], ["src"], CALLERS).select("repo", F.col("dst").alias("id"), F.col("src").alias("other"), "rank")


@query(_CAP.format(k="src", o="dst", e=_E, n=CALLERS))
def callees_capped(spark, d):
    return ranked(edges(spark, d, "CALLS"), ["repo", "src"], ["dst"], CALLERS).select("repo", F.col("src").alias("id"), F.col("dst").alias("other"), "rank")


def linked(spark, d, grain: str) -> DataFrame:
    """Distinct call links between different values of a chunk column."""
    n = nodes(spark, d, grain)
    e = edges(spark, d, "CALLS").select("repo", "src", "dst")
    a = n.select("repo", F.col("id").alias("src"), F.col(grain).alias("a"))
    b = n.select("repo", F.col("id").alias("dst"), F.col(grain).alias("b"))
    return e.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).where("a <> b and a <> '' and b <> ''")


_LINK = "(select distinct e.repo, a.{g} a, b.{g} b from {e} e join {n} a on e.repo=a.repo and e.src=a.id join {n} b on e.repo=b.repo and e.dst=b.id where e.rel='CALLS' and a.{g} <> b.{g} and a.{g} <> '' and b.{g} <> '')"


@query(f"select repo, 'out' direction, a file, b other, rank from (select *, (row_number() over (partition by repo, a order by b))::int rank from {_LINK.format(g='file', e=_E, n=_N)}) where rank <= {FILE_LINKS} union all select repo, 'in', b, a, rank from (select *, (row_number() over (partition by repo, b order by a))::int rank from {_LINK.format(g='file', e=_E, n=_N)}) where rank <= {FILE_LINKS}")
def file_inbound_outbound(spark, d):
    links = linked(spark, d, "file").select("repo", "a", "b").distinct()
    out = ranked(links, ["repo", "a"], ["b"], FILE_LINKS).select("repo", F.lit("out").alias("direction"), F.col("a").alias("file"), F.col("b").alias("other"), "rank")
    into = ranked(links, ["repo", "b"], ["a"], FILE_LINKS).select("repo", F.lit("in").alias("direction"), F.col("b").alias("file"), F.col("a").alias("other"), "rank")
    return out.unionByName(into)


@query(f"select repo, a package, b depends_on, n from (select e.repo, a.package_name a, b.package_name b, count(*) n, row_number() over (partition by e.repo, a.package_name order by b.package_name) r from {_E} e join {_N} a on e.repo=a.repo and e.src=a.id join {_N} b on e.repo=b.repo and e.dst=b.id where e.rel='CALLS' and a.package_name <> b.package_name and a.package_name <> '' and b.package_name <> '' group by 1,2,3) where r <= {PACKAGE_LINKS}")
def package_depends_on(spark, d):
    n = linked(spark, d, "package_name").groupBy("repo", "a", "b").agg(F.count("*").alias("n"))
    return ranked(n, ["repo", "a"], ["b"], PACKAGE_LINKS).select("repo", F.col("a").alias("package"), F.col("b").alias("depends_on"), "n")


@query(f"select repo, id, sibling, rank from (select a.repo, a.id, b.id sibling, (row_number() over (partition by a.repo, a.id order by b.id))::int rank from {_N} a join {_N} b on a.repo=b.repo and a.file=b.file and a.id<>b.id) where rank <= {SIBLINGS}")
def siblings_capped(spark, d):
    """The first of each file, itself aside: of the first six by id five are left for every chunk."""
    n = nodes(spark, d, "file").where("file is not null")
    first = ranked(n, ["repo", "file"], ["id"], SIBLINGS + 1, "at").select("repo", "file", F.col("id").alias("sibling"))
    return ranked(n.join(first, ["repo", "file"]).where("id <> sibling"), ["repo", "id"], ["sibling"], SIBLINGS).select("repo", "id", "sibling", "rank")


@query(f"select repo, id, other, min(priority)::int priority from (select repo, src id, dst other, 1 priority from {_E} where rel='CALLS' union all select repo, src, dst, 2 from {_E} where rel='IMPORTS' union all select repo, src, dst, 3 from {_E} where rel='HAS_MEMBER' union all select repo, dst, src, 3 from {_E} where rel='HAS_MEMBER') group by 1,2,3")
def neighbour_union_distinct(spark, d):
    return neighbours(edges(spark, d))


def neighbours(e: DataFrame) -> DataFrame:
    """``(repo, id, other, priority)``: calls, imports, members and owners, each pair at its best priority."""
    way = lambda rel, a, b, p: e.where(F.col("rel") == rel).select("repo", F.col(a).alias("id"), F.col(b).alias("other"), F.lit(p).alias("priority"))
    every = way("CALLS", "src", "dst", 1).unionByName(way("IMPORTS", "src", "dst", 2)).unionByName(way("HAS_MEMBER", "src", "dst", 3)).unionByName(way("HAS_MEMBER", "dst", "src", 3))
    return every.groupBy("repo", "id", "other").agg(F.min("priority").alias("priority"))


@query(f"select n.repo, n.n_chunks, coalesce(sum(e.n) filter (rel='CONTAINS'),0)::bigint contains, coalesce(sum(e.n) filter (rel='HAS_MEMBER'),0)::bigint has_member, coalesce(sum(e.n) filter (rel='CALLS'),0)::bigint calls, coalesce(sum(e.n) filter (rel='IMPORTS'),0)::bigint imports from (select repo, count(*) n_chunks from {_N} group by 1) n left join (select repo, rel, count(*) n from {_E} group by 1,2) e using (repo) group by 1,2")
def edge_stats(spark, d):
    e = edges(spark, d).groupBy("repo").pivot("rel", ["CONTAINS", "HAS_MEMBER", "CALLS", "IMPORTS"]).count()
    n = nodes(spark, d).groupBy("repo").agg(F.count("*").alias("n_chunks"))
    return n.join(e, "repo", "left").select("repo", "n_chunks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in ("CONTAINS", "HAS_MEMBER", "CALLS", "IMPORTS")])


@query(f"select repo, file, min_by(language, (start_line, id)) as language, count(*) n_chunks, count(*) filter (is_entry_point) n_entry_points, string_agg(name, ',' order by start_line, id) filter (chunk_type <> 'module') as names from {_N} where file is not null group by 1,2")
def file_rollup(spark, d):
    n = nodes(spark, d, "file", "language", "start_line", "name", "chunk_type", "is_entry_point").where("file is not null")
    at = F.struct("start_line", "id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_type") != "module", F.struct("start_line", "id", "name")))), lambda x: x["name"]), ",")
    return n.groupBy("repo", "file").agg(F.min_by("language", at).alias("language"), F.count("*").alias("n_chunks"), F.count_if("is_entry_point").alias("n_entry_points"), F.nullif(names, F.lit("")).alias("names"))


@query(f"select repo, package_name, count(distinct file) n_files, count(*) n_chunks, max_by(language, (file, id)) as language, string_agg(distinct file, ',' order by file) files from {_N} where package_name <> '' and chunk_type <> 'module' group by 1,2")
def package_rollup(spark, d):
    n = nodes(spark, d, "file", "language", "package_name", "chunk_type").where("package_name <> '' and chunk_type <> 'module'")
    return n.groupBy("repo", "package_name").agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_chunks"), F.max_by("language", F.struct("file", "id")).alias("language"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query(f"select repo, file, chunk_type, grouping(file)::int no_file, grouping(chunk_type)::int no_type, count(*) n, sum(length(code))::bigint n_chars from {_N} group by rollup(repo, file, chunk_type)")
def hierarchy_rollup(spark, d):
    n = nodes(spark, d, "file", "chunk_type", F.length("code").alias("chars"))
    return n.rollup("repo", "file", "chunk_type").agg(F.grouping("file").cast("int").alias("no_file"), F.grouping("chunk_type").cast("int").alias("no_type"), F.count("*").alias("n"), F.sum("chars").alias("n_chars"))


@query(f"select repo, string_agg(distinct language, ',' order by language) languages from {_N} where chunk_type <> 'module' group by 1")
def languages_distinct(spark, d):
    return nodes(spark, d, "language", "chunk_type").where("chunk_type <> 'module'").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query(f"select language, chunk_type, count(*) n, sum(len(string_split(code, chr(10))))::bigint n_lines from {_N} group by 1,2")
def language_line_counts(spark, d):
    return nodes(spark, d, "language", "chunk_type", F.size(F.split("code", "\n")).alias("lines")).groupBy("language", "chunk_type").agg(F.count("*").alias("n"), F.sum("lines").alias("n_lines"))


@query(f"select repo, (row_number() over (partition by repo order by coalesce(entry_point_type,''), name, id))::int as position, coalesce(entry_point_type,'') entry_type, name, id from {_N} where is_entry_point")
def entry_points_sorted(spark, d):
    n = nodes(spark, d, "name", "is_entry_point", text.or_empty(F.col("entry_point_type")).alias("entry_type")).where("is_entry_point")
    return n.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy("entry_type", "name", "id")).alias("position"), "entry_type", "name", "id")


@query(f"select distinct repo, src, dst from edges e where rel='CALLS' and exists (select 1 from chunks c where c.repo=e.repo and c.id=e.src) and exists (select 1 from chunks c where c.repo=e.repo and c.id=e.dst)")
def calls_dedup_validated(spark, d):
    n = nodes(spark, d)
    return edges(spark, d, "CALLS").select("repo", "src", "dst").join(n.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(n.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi").select("repo", "src", "dst")


@query(f"""with i as (select distinct n.repo, n.id, v.from_path, m.module from (select repo, id, unnest(map_values(imports_map)) v from {_N} where language='go') n join (select repo, min(nullif(module,'')) as module from go_mod group by 1) m using (repo) where starts_with(v.from_path, m.module || '/'))
select distinct i.repo, i.id as src, t.id as dst, i.from_path as attr from i join {_N} t on t.repo=i.repo and regexp_replace(t.file,'/[^/]*$','') = substr(i.from_path, length(i.module)+2) and t.file like '%.go' and t.chunk_type in ('struct','interface','function')""")
def import_edges_explode(spark, d):
    mods = table(spark, d, "go_mod").groupBy("repo").agg(F.min(F.nullif("module", F.lit(""))).alias("module"))
    i = nodes(spark, d, "language", "imports_map").where("language = 'go'").select("repo", F.col("id").alias("src"), F.explode(F.map_values("imports_map")).alias("i")).select("repo", "src", F.col("i.from_path").alias("attr")).distinct()
    i = i.join(mods, "repo").where(F.expr("startswith(attr, module || '/')")).withColumn("dir", F.expr("substring(attr, length(module) + 2)"))
    t = nodes(spark, d, "file", "chunk_type").where("chunk_type in ('struct', 'interface', 'function') and file like '%.go'").select("repo", F.col("id").alias("dst"), F.regexp_replace("file", r"/[^/]*$", "").alias("dir"))
    return i.join(t, ["repo", "dir"]).select("repo", "src", "dst", "attr")


# --- traversals


def level_reach(starts: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """``(repo, start, id, depth)``: least depth of what is reached in up to ``depth`` steps."""
    seen = cut(starts.select("repo", F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for k in range(1, depth + 1):
        new = frontier.join(step, ["repo", "id"]).select("repo", "start", F.col("other").alias("id")).distinct()
        frontier = cut(new.join(seen, ["repo", "start", "id"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query(f"""with recursive e as (select repo, src, dst from {_E} where rel='CALLS'), r as (select distinct repo, id start, id, 0 as depth from {_N} where is_entry_point
 union select r.repo, r.start, e.dst, r.depth + 1 from r join e on e.repo=r.repo and e.src=r.id where r.depth < 5)
select repo, start, id, min(depth)::int as depth from r group by 1,2,3""")
def reachability_min_depth(spark, d):
    step = edges(spark, d, "CALLS").select("repo", F.col("src").alias("id"), F.col("dst").alias("other"))
    return level_reach(nodes(spark, d, "is_entry_point").where("is_entry_point"), step, 5)


def detect_flows(n: DataFrame, calls: DataFrame, steps: int = FLOW_STEPS, fan_out: int = FAN_OUT) -> DataFrame:
    """``(repo, entry, step, id)``: first-in-first-out traversal from every entry over callees that are no entries.

    Per node the first ``fan_out`` callees by id; a node counts where it is met
    first; a flow ends at ``steps`` nodes. All entries advance a level at a time:
    the order of a level is that of its parents, then of the callee's id.
    """
    entries = n.where("is_entry_point").select("repo", "id")
    inner = n.where("not coalesce(is_entry_point, false)").select("repo", F.col("id").alias("other"))
    step = calls.select("repo", F.col("src").alias("id"), F.col("dst").alias("other")).join(inner, ["repo", "other"], "left_semi")
    return ordered_walk(entries, cut(ranked(step, ["repo", "id"], ["other"], fan_out)), steps)


def ordered_walk(entries: DataFrame, step: DataFrame, steps: int) -> DataFrame:
    """``(repo, entry, step, id)``: first in, first out from every entry over ``step(repo, id, other, rank)``, up to ``steps`` nodes each."""
    seen = cut(entries.select("repo", F.col("id").alias("entry"), "id", F.lit(1).alias("step")))
    frontier = seen
    for _ in range(steps - 1):
        met = frontier.join(step, ["repo", "id"]).select("repo", "entry", F.col("other").alias("id"), "step", "rank")
        met = met.groupBy("repo", "entry", "id").agg(F.min(F.struct("step", "rank")).alias("at")).join(seen, ["repo", "entry", "id"], "left_anti")
        size = seen.groupBy("repo", "entry").agg(F.max("step").alias("n"))
        at = F.row_number().over(Window.partitionBy("repo", "entry").orderBy("at", "id"))
        new = met.withColumn("k", at).where(F.col("k") <= steps).join(size, ["repo", "entry"]).select("repo", "entry", "id", (F.col("n") + F.col("k")).alias("step"))
        frontier = cut(new.where(F.col("step") <= steps))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query()
def flow_detect(spark, d):
    return detect_flows(nodes(spark, d, "is_entry_point"), edges(spark, d, "CALLS"))


@query()
def part_of_flow_link(spark, d):
    """Flows with their steps as JSON, files and packages."""
    n = nodes(spark, d, "is_entry_point", "name", "file", "signature", "package_name", "entry_point_type", "entry_point_route")
    f = detect_flows(n, edges(spark, d, "CALLS")).join(n, ["repo", "id"])
    step = F.struct("step", "id", "name", "file", "signature", "package_name")
    g = f.groupBy("repo", "entry").agg(
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.max(F.when(F.col("id") == F.col("entry"), text.flow_name(F.col("entry_point_type"), F.col("entry_point_route"), F.col("name")))).alias("flow"),
    )
    return g.select("repo", "entry", "flow", F.size("steps").alias("n_steps"), F.to_json("steps").alias("steps"), F.array_join(F.array_sort(F.array_distinct(F.col("steps.file"))), ",").alias("files"), F.array_join(F.array_sort(F.array_distinct(F.col("steps.package_name"))), ",").alias("packages"))


def budgeted_expansion(seeds: DataFrame, n: DataFrame, e: DataFrame, budget: int = 4000) -> DataFrame:
    """``(query_id, repo, id, position, tokens)``: expansion of seeds through the graph under a token budget; ``n(repo, id, file, size)``.

    First in, first out: a node that does not fit is skipped and not expanded;
    an accepted one queues its neighbours by priority and id, then up to five
    others of its file while less than half of the budget is used; what was
    queued once is never queued again. Levels are joins over all queries, until no
    queue is left. Inside a level the greedy acceptance folds over the queue of each
    query. What is used only grows, so of nodes of one size the first that do not
    fit end it: of each size only as many as the rest of the budget holds are folded,
    and a hub of any degree gives no more than a budget's rows.
    """
    sized = n.select("repo", "id", "size")
    near = neighbours(e).select("repo", "id", F.col("other").alias("next"), "priority")
    kin = siblings(n).select("repo", "id", F.col("sibling").alias("next"), F.lit(9).alias("priority"))
    way = cut(near.withColumn("kin", F.lit(False)).unionByName(kin.withColumn("kin", F.lit(True))))
    queue = cut(seeds.select("query_id", "repo", "id", F.col("at").cast("long").alias("at")).groupBy("query_id", "repo", "id").agg(F.min("at").alias("at")))
    seen, state, out = queue.select("query_id", "repo", "id"), None, None
    while not queue.isEmpty():
        item = F.struct("at", "repo", "id", "size")
        q = queue.join(sized, ["repo", "id"])
        q = q.join(state, "query_id", "left") if state is not None else q.withColumn("used", F.lit(0)).withColumn("n", F.lit(0))
        at = F.row_number().over(Window.partitionBy("query_id", "size").orderBy("at", "repo", "id"))
        q = q.withColumn("of_size", at).where((F.col("size") == 0) | (F.col("of_size") * F.col("size") <= budget - F.coalesce("used", F.lit(0))))
        q = q.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("used").alias("used"), F.max("n").alias("n"))
        start = F.struct(F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("n", F.lit(0)).alias("n"), F.expr("cast(array() as array<struct<repo:string,id:string,position:int,tokens:int,kin:boolean>>)").alias("got"))

        def take(acc: Column, x: Column) -> Column:
            used = acc["used"] + x["size"]
            ok = (acc["used"] < budget) & (used <= budget)
            row = F.struct(x["repo"].alias("repo"), x["id"].alias("id"), (acc["n"] + 1).alias("position"), x["size"].alias("tokens"), (used * 2 < budget).alias("kin"))
            return F.when(ok, F.struct(used.alias("used"), (acc["n"] + 1).alias("n"), F.concat(acc["got"], F.array(row)).alias("got"))).otherwise(acc)

        folded = cut(q.select("query_id", F.aggregate("items", start, take).alias("r")))
        got = folded.select("query_id", F.explode("r.got").alias("g")).select("query_id", "g.*")
        out = got if out is None else out.unionByName(got)
        state = folded.select("query_id", "r.used", "r.n") if state is None else cut(folded.select("query_id", "r.used", "r.n").unionByName(state.join(folded, "query_id", "left_anti")))
        more = got.withColumnRenamed("kin", "half").join(way, ["repo", "id"]).where("not kin or half")
        more = more.groupBy("query_id", "repo", F.col("next").alias("id")).agg(F.min(F.struct("position", "priority")).alias("o"))
        more = more.join(seen, ["query_id", "repo", "id"], "left_anti").join(state.where(F.col("used") < budget).select("query_id"), "query_id", "left_semi")
        queue = cut(more.select("query_id", "repo", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id")).cast("long").alias("at")))
        seen = seen.unionByName(queue.select("query_id", "repo", "id"))
    empty = seeds.sparkSession.createDataFrame([], "query_id string, repo string, id string, position int, tokens int")
    return out.select("query_id", "repo", "id", "position", "tokens") if out is not None else empty


def siblings(n: DataFrame) -> DataFrame:
    m = n.select("repo", "id", "file").where("file is not null")
    first = ranked(m, ["repo", "file"], ["id"], SIBLINGS + 1, "at").select("repo", "file", F.col("id").alias("sibling"))
    return ranked(m.join(first, ["repo", "file"]).where("id <> sibling"), ["repo", "id"], ["sibling"], SIBLINGS)


@query()
def budgeted_bfs(spark, d):
    """One query per repository, seeded with its first three entry points."""
    n = nodes(spark, d, "file", text.token_estimate(F.col("code")).alias("size"), "is_entry_point")
    seeds = ranked(n.where("is_entry_point"), ["repo"], ["id"], 3, "at").select(F.col("repo").alias("query_id"), "repo", "id", "at")
    return budgeted_expansion(seeds, n, edges(spark, d))
