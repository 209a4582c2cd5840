"""Nearest neighbours of a stated set of query vectors, exactly, in blocks.

Query vectors of up to ``NUMBERS_SENT`` numbers are broadcast, and the rows stay where they are:
each task keeps the best of its part for every query, and a window ranks what the
tasks return. More queries and the rows are numbered into blocks of ``BLOCK``; query
blocks meet every row block once, so that one task holds two blocks. Distances are
squared Euclidean in double precision; a matrix product finds who may be among the
best, with a margin for its rounding, and these are computed exactly.

Defined results: null vectors are neither queries nor neighbours; ties go to the
smaller id; fewer than ``k`` rows give fewer neighbours; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treadle.functions import text
from treadle.session import cut, table

BLOCK = 4096
#: Numbers in the query vectors that are broadcast at most (32 MB), and queries that meet a block of rows at a time.
NUMBERS_SENT = 1 << 22
QUERY_BLOCK = 1024

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _among(q_ids, q, r_ids, r, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each query; ties go to the smaller id."""
    k = min(k, len(r))
    q2, r2 = (q * q).sum(axis=1)[:, None], (r * r).sum(axis=1)
    rough = q2 + r2 - 2 * (q @ r.T)
    margin = 1e-9 * (q2 + r2.max())
    at, of = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + margin)
    exact = ((r[of] - q[at]) ** 2).sum(axis=1)
    order = np.lexsort((r_ids[of], exact, at))
    at, of, exact = at[order], of[order], exact[order]
    first = np.searchsorted(at, np.arange(len(q)))
    keep = np.arange(len(at)) - first[at] < k
    return pd.DataFrame({"query_id": q_ids[at[keep]], "id": r_ids[of[keep]], "distance": exact[keep]})


def _matrix(v) -> np.ndarray:
    return np.array(list(v), np.float64)


def _best(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        q_ids, q, r_ids, r = left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"])
        return pd.concat([_among(q_ids[b : b + QUERY_BLOCK], q[b : b + QUERY_BLOCK], r_ids, r, k) for b in range(0, len(q), QUERY_BLOCK)])

    return run


def _sent(k: int, queries):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = queries.value
        best = None
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                part = pdf.iloc[a : a + BLOCK]
                ids, r = part["id"].to_numpy(), _matrix(part["v"])
                found = [_among(q_ids[b : b + QUERY_BLOCK], q[b : b + QUERY_BLOCK], ids, r, k) for b in range(0, len(q), QUERY_BLOCK)]
                best = pd.concat([*found] if best is None else [best, *found])
                best = best.sort_values(["query_id", "distance", "id"], kind="stable").groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, id, distance, rank)`` of ``queries(id, v)`` among ``rows(id, v)``."""
    spark = rows.sparkSession
    queries, rows = cut(queries.where("v is not null").select("id", "v")), rows.where("v is not null")
    count, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    schema = "query_id long, id long, distance double"
    if 0 < numbers <= NUMBERS_SENT:
        q = queries.toPandas()
        sent = spark.sparkContext.broadcast((q["id"].to_numpy(), _matrix(q["v"])))
        pairs = rows.select("id", "v").mapInPandas(_sent(k, sent), schema)
    else:
        n_q = max(1, -(-count // BLOCK))
        n_r = max(1, -(-rows.count() // BLOCK))
        place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        q = queries.withColumn("qb", place(n_q)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
        r = rows.withColumn("rb", place(n_r)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
        pairs = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(_best(k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


_DIST = "list_sum(list_transform(range(1, len(a.embedding)+1), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))"
_TOP = "(select a.vec_id query_id, b.vec_id id, {d} dist, (row_number() over (partition by a.vec_id order by {d}, b.vec_id))::int rank from embeddings a, embeddings b where a.vec_id % 100 = 0 {w})"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.where(F.col("id") % 100 == 0).select("id", "v"), e


@query(f"select query_id, id, rank, round(greatest(0.0, 1.0 - dist/2), 6) score from {_TOP.format(d=_DIST, w='')} where rank <= 10")
def vector_topk_batch(spark, d):
    q, e = _vectors(spark, d)
    return nearest(q, e.select("id", "v")).select("query_id", "id", "rank", F.round(text.score(F.col("distance")), 6).alias("score"))


@query(f"select query_id, id, rank, round(greatest(0.0, 1.0 - dist/2), 6) score from {_TOP.format(d=_DIST, w='and b.label = 3')} where rank <= 10")
def vector_topk_filtered(spark, d):
    q, e = _vectors(spark, d)
    return nearest(q, e.where("label = 3").select("id", "v")).select("query_id", "id", "rank", F.round(text.score(F.col("distance")), 6).alias("score"))


@query(f"""select query_id, string_agg('[' || rank || '] ' || coalesce(source,'Unknown') || ' (' || coalesce(doc_kind,'Unknown') || '): ' || coalesce(text[1:80],''), chr(10) order by rank) context
 from {_TOP.format(d=_DIST, w='')} t left join documents on doc_id = id where rank <= 5 group by 1""")
def vector_seed_join_context(spark, d):
    """Seeds of each query with their documents, as the numbered context of an answer."""
    q, e = _vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "doc_kind", "text")
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("source", F.lit("Unknown")), F.lit(" ("), F.coalesce("doc_kind", F.lit("Unknown")), F.lit("): "), text.or_empty(F.substring("text", 1, 80)))
    t = nearest(q, e.select("id", "v"), 5).join(docs, "id", "left").withColumn("line", line)
    return t.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def hashed_embedding(texts: Iterator[pd.Series], size: int = 64) -> Iterator[pd.Series]:
    """The offline provider: signed feature hashing of words, to unit length; one function for index and query."""
    import zlib

    for batch in texts:
        out = []
        for t in batch:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x80000000 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        yield pd.Series(out)


def http_embedding(url: str, model: str, key: str | None = None, batch: int = 32, post=None):
    """A provider behind an address: texts in batches, replies put in the order of their ``index``.

    ``post(url, body, headers)`` returns the reply as JSON text; without one the standard library's client is used.
    """
    import json
    import urllib.request

    def send(to, body, headers):
        with urllib.request.urlopen(urllib.request.Request(to, body.encode(), headers), timeout=60) as r:
            return r.read().decode()

    call = post or send
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out, inputs = [], [t or "" for t in part]
            for a in range(0, len(inputs), batch):
                reply = json.loads(call(url, json.dumps({"model": model, "input": inputs[a : a + batch]}), headers))
                out += [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]
            yield pd.Series(out)

    return run


#: Embedding providers by name; a provider is an iterator function over batches of texts, so that a model is loaded once per task.
EMBEDDERS = {"hashing": hashed_embedding}


def embed(df: DataFrame, column: str, provider: str = "hashing") -> DataFrame:
    return df.withColumn("embedding", F.pandas_udf(EMBEDDERS[provider], "array<float>", functionType=204)(F.col(column)))


@query()
def embed_and_search(spark: SparkSession, d: str):
    """Chunks embedded by the offline provider; every hundredth is a query against all."""
    c = table(spark, d, "chunks").select("chunk_no", "signature", "name").dropDuplicates(["chunk_no"])
    e = cut(embed(c.select(F.col("chunk_no").alias("id"), F.concat_ws(" ", "name", "signature").alias("t")), "t").select("id", F.col("embedding").alias("v")))
    return nearest(e.where("id % 100 = 0"), e, 5).select("query_id", "id", "rank", F.round(text.score(F.col("distance")), 6).alias("score"))
