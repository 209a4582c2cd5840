"""Incremental ingest: source rows stream in, are parsed, and upserted by chunk id.

The stream carries no state of its own: the store's key makes a batch that is
delivered again harmless, and the checkpoint folder keeps what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from treadle.functions.parsers import parse_sources
from treadle.operators.store import upsert
from treadle.session import shared_dir, ship

SOURCE = "repo string, path string, content string"


def ingest(spark: SparkSession, folder: str, store: str, name: str = "ingest", once: bool = True) -> StreamingQuery:
    """Parquet source rows appearing in ``folder`` to chunks in ``store``."""
    ship(spark)

    def batch(df: DataFrame, _: int) -> None:
        chunks = parse_sources(df.dropDuplicates(["repo", "path", "content"])).where("error is null")
        upsert(chunks, store, ["repo", "id"])

    stream = spark.readStream.schema(SOURCE).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}")
    return (stream.trigger(availableNow=True) if once else stream).start()
