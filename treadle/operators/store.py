"""The store of an index: overwrite and upsert by key, delete, catalogue and incremental runs.

A table is Parquet, partitioned by ``repo``; a write replaces the partitions it
holds and leaves the others (dynamic partition overwrite). An upsert is the new
rows with the old ones whose key is not among them.

Defined results: of several new rows of one key the last by ``order`` counts;
rows with a null key are kept apart, as nothing equals null; a table that does
not exist is empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treadle.functions import text
from treadle.session import cut, table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the repositories that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    if order:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last()))).where("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, path: str, key: list[str], order: str | None = None) -> None:
    """Upsert into the store; only the partitions that change are rewritten."""
    spark = df.sparkSession
    old = read(spark, path, df.schema)
    touched = old.join(df.select("repo").distinct(), "repo", "left_semi")
    overwrite(cut(upserted(touched, df, key, order)), path)


def delete_repo(spark: SparkSession, path: str, repo: str) -> None:
    """Remove one repository's partition."""
    jvm, name = spark.sparkContext._jvm, repo.replace("/", "%2F")
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/repo={name}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def has_repo(df: DataFrame, repo: str) -> bool:
    return not df.where(F.col("repo") == repo).limit(1).isEmpty()


_N = "(select distinct on (chunk_no) * from chunks)"


@query("select repo, id, code, loaded_at, case when n > 1 then 'new' else 'old' end origin from (select *, row_number() over (partition by repo, id order by loaded_at desc) r, count(*) over (partition by repo, id) n from chunks) where r = 1")
def upsert_redelivered(spark, d):
    """All chunks with their whole code: the first deliveries, upserted with the later ones."""
    c = table(spark, d, "chunks").select("repo", "id", "code", "loaded_at")
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "id").orderBy("loaded_at")))
    old = c.where("_n = 1").drop("_n").withColumn("origin", F.lit("old"))
    new = c.where("_n > 1").drop("_n").withColumn("origin", F.lit("new"))
    return upserted(old, new, ["repo", "id"], "loaded_at")


@query(f"select c.chunk_no, substr(md5(code),1,8) digest from {_N} c where code is not null and not coalesce(date_trunc('month', indexed_at) < (select date_trunc('month', max(indexed_at)) from chunks), false)")
def incremental_changed_only(spark, d):
    """Chunks whose hash is not in the state of an earlier run (here: one at the end of the month before the last)."""
    c = table(spark, d, "chunks").select("chunk_no", text.content_hash(F.col("code")).alias("digest"), F.date_trunc("month", "indexed_at").alias("month")).dropDuplicates(["chunk_no"])
    last = c.agg(F.max("month").alias("last"))
    state = c.join(F.broadcast(last), F.col("month") < F.col("last"), "left_semi").select("chunk_no", "digest")
    return c.where("digest is not null").join(state, ["chunk_no", "digest"], "left_anti").select("chunk_no", "digest")


@query(f"select chunk_no, repo from {_N} c where not exists (select 1 from chunk_deletes x where x.repo = c.repo and x.id = c.id)")
def delete_filter(spark, d):
    gone = table(spark, d, "chunk_deletes").select("repo", "id").distinct()
    return table(spark, d, "chunks").select("chunk_no", "repo", "id").dropDuplicates(["chunk_no"]).join(gone, ["repo", "id"], "left_anti").select("chunk_no", "repo")


@query(f"select repo, count(*) n_chunks, count(distinct file) n_files, min(indexed_at) first_indexed, max(indexed_at) last_indexed from {_N} where repo is not null group by 1")
def repo_catalog(spark, d):
    c = table(spark, d, "chunks").select("chunk_no", "repo", "file", "indexed_at").dropDuplicates(["chunk_no"]).where("repo is not null")
    return c.groupBy("repo").agg(F.count("*").alias("n_chunks"), F.count_distinct("file").alias("n_files"), F.min("indexed_at").alias("first_indexed"), F.max("indexed_at").alias("last_indexed"))


@query(f"select c.chunk_no, coalesce(nullif(d.text,''), c.name) as summary from {_N} c left join (select doc_id, text from documents where doc_kind = 'chunk_context') d on d.doc_id = c.chunk_no")
def file_summary_coalesce(spark, d):
    """Update by match: the new summary where there is one, else what was there."""
    new = table(spark, d, "documents").where("doc_kind = 'chunk_context'").select(F.col("doc_id").alias("chunk_no"), "text")
    c = table(spark, d, "chunks").select("chunk_no", "name").dropDuplicates(["chunk_no"])
    return c.join(new, "chunk_no", "left").select("chunk_no", F.coalesce(F.nullif("text", F.lit("")), "name").alias("summary"))
