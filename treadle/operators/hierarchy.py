"""Parent-child links to full hierarchies, with cycles.

Links are placed by the file of the child, where the parent mostly is too. In
each partition a weighted disjoint-set forest joins the links whose both ends
are there: every node gets its local root and its distance to it (paths are
compressed by halving until nothing moves). Only local roots whose parent lies
elsewhere remain; these few are the nodes of a contracted graph, whose weighted
links are merged by the same halving as joins, in as many rounds as the
logarithm of its depth. What never reaches a root leads into a ring; the rings
are the nodes that stay reachable however often the links are doubled.

A group of one file that is larger than ``HOT_ROWS`` is salted over several
parts: any placement is right, it only decides how much is left to merge. The
part of a node is written with it, and both passes over the nodes are split into
the same fixed number of parts, which adaptive execution does not coalesce.

Defined results: a null or empty parent and one that no row has make a root; a
chunk that is its own parent is a ring of one; rows delivered twice count once,
of different parents of one key the least ``chunk_no``'s counts; rows with a null
key are left out; nodes that lead into a ring have a null root, depth and path;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.session import absent, cut, table

#: Rows of one placement group beyond which it is spread over partitions.
HOT_ROWS = 500_000


def _forest(no: np.ndarray, parent: np.ndarray):
    """Weighted disjoint sets of one partition.

    ``parent`` is -1 for roots. Returns for each node the index of its local
    root, the distance, and whether it is in or leads into a local ring.
    """
    n = len(no)
    order = np.argsort(no, kind="stable")
    at = np.searchsorted(no[order], parent)
    at = np.minimum(at, max(n - 1, 0))
    here = order[at]
    local = (no[here] == parent) & (parent != -1)
    me = np.arange(n)
    up = np.where(local, here, me)
    dist = local.astype(np.int64)
    ringed = local & (here == me)
    dist[ringed] = 1
    end = ~local
    jump = up.copy()
    for _ in range(int(np.ceil(np.log2(n + 1))) + 1):
        if end[jump].all():
            break
        dist = np.where(end, 0, dist + np.where(end[jump], 0, dist[jump]))
        jump = np.where(end, jump, jump[jump])
    lost = ~end[jump]
    inside = np.zeros(n, bool)
    if lost.any():  # the jumps are now longer than any way into a ring
        inside[jump[lost]] = True
    return up, jump, dist, lost, inside, local


def _local(batches: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    pdfs = list(batches)
    if not pdfs or not sum(map(len, pdfs)):
        return
    pdf = pd.concat(pdfs, ignore_index=True)
    no = pdf["no"].to_numpy(np.int64)
    parent = pdf["parent_no"].fillna(-1).to_numpy(np.int64)
    up, root, dist, lost, inside, local = _forest(no, parent)
    out = pd.DataFrame({"no": no, "lroot": no[root], "dist": dist, "lost": lost, "inside": inside})
    out["exit"] = pd.array(np.where(lost, -1, parent[root]), "Int64")
    out.loc[out["exit"] == -1, "exit"] = pd.NA
    if paths:
        out["path"] = _climb(no, up, dist, lost)
    yield out


def _climb(no, up, dist, lost):
    """Ways from each node to its local root, both included, by increasing distance."""
    out: list = [None] * len(no)
    for i in np.argsort(dist, kind="stable"):
        if not lost[i]:
            out[i] = [no[i]] if dist[i] == 0 else [no[i], *out[up[i]]]
    return out


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes on the ways from marked nodes to their local roots."""
    pdfs = list(batches)
    if not pdfs or not sum(map(len, pdfs)):
        return
    pdf = pd.concat(pdfs, ignore_index=True)
    mark = pdf["mark"].to_numpy(bool)
    if not mark.any():
        return
    no = pdf["no"].to_numpy(np.int64)
    jump = _forest(no, pdf["parent_no"].fillna(-1).to_numpy(np.int64))[0]
    for _ in range(int(np.ceil(np.log2(len(no) + 1))) + 1):
        more = mark.copy()
        np.logical_or.at(more, jump[mark], True)
        if (more == mark).all() and (jump[jump] == jump).all():
            break
        mark, jump = more, jump[jump]
    yield pd.DataFrame({"no": no[mark]})


def links(chunks: DataFrame) -> DataFrame:
    """``(no, parent_no, home)``: each chunk once, its parent's number, the group it is placed by."""
    one = (
        chunks.where("chunk_no is not null and repo is not null and id is not null")
        .groupBy("repo", "id")
        .agg(F.min_by(F.struct("chunk_no", absent(F.col("parent")).alias("parent"), "file"), "chunk_no").alias("c"))
        .select("repo", "id", F.col("c.chunk_no").alias("no"), F.col("c.parent").alias("parent"), F.xxhash64("repo", "c.file").alias("home"))
    )
    p = one.select(F.col("repo").alias("_r"), F.col("id").alias("_i"), F.col("no").alias("parent_no"))
    return one.join(p, (F.col("repo") == F.col("_r")) & (F.col("parent") == F.col("_i")), "left").select("no", "parent_no", "home")


def placed(nodes: DataFrame) -> DataFrame:
    """Salt the groups that would not fit one task."""
    hot = nodes.groupBy("home").count().where(F.col("count") > HOT_ROWS).select("home", F.ceil(F.col("count") / HOT_ROWS).alias("salts"))
    return (
        nodes.join(hot, "home", "left")
        .withColumn("home", F.when(F.col("salts").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("no"), "salts"))))
        .drop("salts")
    )


def _doubled(d: DataFrame, paths: bool) -> DataFrame:
    """One round: every link is followed by the link of its end."""
    b = d.select(F.col("no").alias("bn"), F.col("ptr").alias("bptr"), F.col("w").alias("bw"), *([F.col("path").alias("bp")] if paths else []))
    j = d.join(b, d["ptr"] == b["bn"], "left")
    out = [
        F.col("no"),
        F.when(F.col("bptr").isNull(), F.col("ptr")).otherwise(F.col("bptr")).alias("ptr"),
        (F.col("w") + F.coalesce("bw", F.lit(0))).alias("w"),
    ]
    if paths:
        out.append(F.when(F.col("bp").isNull(), F.col("path")).otherwise(F.concat("path", "bp")).alias("path"))
    return j.select(*out)


def resolve(chunks: DataFrame, paths: bool = False) -> dict[str, DataFrame]:
    """``nodes`` with their local forest, ``top`` with the way of local roots to
    global ones, ``rings`` with the numbers of all nodes in a ring."""
    nodes = cut(placed(links(chunks)))
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // HOT_ROWS))
    spread = nodes.repartition(parts, "home")
    schema = "no long, lroot long, dist long, lost boolean, inside boolean, exit long" + ", path array<long>" * paths
    local = cut(spread.select("no", "parent_no").mapInPandas(lambda b: _local(b, paths), schema))

    # the contracted graph: local roots whose parent is placed elsewhere
    exits = local.where("exit is not null and no = lroot").select("no", "exit")
    far = local.select(F.col("no").alias("exit"), F.col("lroot").alias("to"), (F.col("dist") + 1).alias("w"), F.col("lost").alias("to_lost"), *(["path"] if paths else []))
    steps = cut(exits.join(far, "exit"))
    ends = steps.where("not to_lost")
    into = steps.where("to_lost").select("no").withColumn("x", F.lit(True))
    d = ends.select("no", F.col("to").alias("ptr"), "w", *(["path"] if paths else []))
    live, images, before = d, None, None
    moving = steps.select("no")
    while True:
        # what still moves: links whose end has itself a link
        live = cut(_doubled(live, paths))
        active = live.join(moving.withColumnRenamed("no", "ptr"), "ptr", "left_semi")
        seen = active.agg(F.count("*").alias("a"), F.count_distinct("ptr").alias("i")).first()
        if (seen.a, seen.i) == before or seen.a == 0:
            images = active.select(F.col("ptr").alias("no")).distinct()
            break
        before = (seen.a, seen.i)
    # a ring of contracted nodes; those that lead into a local ring have no link of their own
    ring_roots = images.join(into, "no", "left_anti")
    entries = ring_roots.join(steps, "no").select(F.col("exit").alias("no")).distinct().withColumn("mark", F.lit(True))
    marked = (
        nodes.join(entries, "no", "left")
        .select("no", "parent_no", "home", F.coalesce("mark", F.lit(False)).alias("mark"))
        .repartition(parts, "home")
        .select("no", "parent_no", "mark")
        .mapInPandas(_marked, "no long")
    )
    rings = local.where("inside").select("no").unionByName(marked).distinct()
    return {"nodes": nodes, "local": local, "steps": steps, "top": live, "rings": rings}


def cycle_members(chunks: DataFrame) -> DataFrame:
    """``chunk_no`` of the chunks whose parents lead back to themselves."""
    return resolve(chunks)["rings"].withColumnRenamed("no", "chunk_no")


def hierarchy(chunks: DataFrame) -> DataFrame:
    """``(chunk_no, root_no, depth, path, in_cycle, leads_to_cycle)`` of each chunk; ``path`` runs from the root."""
    r = resolve(chunks, paths=True)
    local = r["local"]
    # ends that have a link themselves, or lead into a local ring, never reach a root
    blocked = r["steps"].select(F.col("no").alias("end")).distinct()
    top = (
        r["top"].withColumnRenamed("ptr", "end").join(blocked.withColumn("b", F.lit(True)), "end", "left")
        .select(F.col("no").alias("lroot"), F.when(F.col("b").isNull(), F.col("end")).alias("groot"), "w", F.col("path").alias("tail"))
    )
    stuck = r["steps"].select(F.col("no").alias("lroot")).distinct().withColumn("stuck", F.lit(True))
    joined = local.join(top, "lroot", "left").join(stuck, "lroot", "left").join(r["rings"].withColumn("ring", F.lit(True)), "no", "left")
    leads = F.col("lost") | (F.col("stuck").isNotNull() & F.col("groot").isNull())
    whole = F.reverse(F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")))
    return joined.select(
        F.col("no").alias("chunk_no"),
        F.when(~leads, F.coalesce("groot", "lroot")).alias("root_no"),
        F.when(~leads, F.col("dist") + F.coalesce("w", F.lit(0))).alias("depth"),
        F.when(~leads, whole).alias("path"),
        F.coalesce("ring", F.lit(False)).alias("in_cycle"),
        leads.alias("leads_to_cycle"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor_no, chunk_no, distance)`` of every proper descendant, from the materialised paths."""
    return (
        tree.where("path is not null")
        .select("chunk_no", "depth", F.posexplode("path").alias("at", "ancestor_no"))
        .where("ancestor_no <> chunk_no")
        .select("ancestor_no", "chunk_no", (F.col("depth") - F.col("at")).alias("distance"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cycle_members(table(spark, d, "chunks"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The path as text, of chunk numbers from the root."""
    return hierarchy(table(spark, d, "chunks")).withColumn("path", F.concat_ws("/", F.col("path").cast("array<string>")))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "chunks")))


_SQL = """
with recursive one as (select repo, id, min(chunk_no) no, arg_min(nullif(parent,''), chunk_no) parent from chunks
    where repo is not null and id is not null group by all),
link as (select a.no, b.no up from one a left join one b on a.repo = b.repo and a.parent = b.id),
reach as (select no, up from link where up is not null
          union select r.no, l.up from reach r join link l on r.up = l.no where l.up is not null),
ring as (select no from reach where no = up),
into_ring as (select no from ring union select r.no from reach r join ring on r.up = ring.no)
"""
_TREE = (
    _SQL
    + """, tree as (select l.no, l.no root, 0::bigint depth, l.no::varchar path from link l where up is null
   union all select l.no, t.root, t.depth + 1, t.path || '/' || l.no from tree t join link l on l.up = t.no)
"""
)

SQL = {
    "p3_found": _SQL + "select no chunk_no from ring",
    "p3_hierarchy": _TREE
    + """select l.no chunk_no, t.root root_no, t.depth, coalesce(t.path, '') path, l.no in (select no from ring) in_cycle,
      l.no in (select no from into_ring) leads_to_cycle from link l left join tree t on l.no = t.no""",
    "p3_descendants": _TREE
    + """, up as (select no, up, 1::bigint distance from link where up is not null and no in (select no from tree)
     union all select u.no, l.up, u.distance + 1 from up u join link l on l.no = u.up where l.up is not null)
    select up ancestor_no, no chunk_no, distance from up""",
}

QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}
