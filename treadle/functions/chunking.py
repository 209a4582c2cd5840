"""Generic chunks of a text: at lines that begin a definition, or by size with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDARY = r"(?i)^(def |function |func |fn |sub |class |struct |interface )"
LEAST, SIZE, OVERLAP_LINES = 50, 1500, 5


def boundary_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block, body)``: lines from one boundary to the next; short blocks are dropped."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    marked = lines.withColumn("block", F.sum(F.trim("line").rlike(BOUNDARY).cast("long")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(key, "block").agg(body.alias("body")).where(F.length("body") >= LEAST)


_BEGINS = re.compile(r"(?:def|function|func|fn|sub|class|struct|interface)\s+([a-zA-Z_]\w*)", re.I)


def split_at_boundaries(text: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, body) from one line that begins a definition to the next; none without such lines."""
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if i and _BEGINS.match(line.strip())]
    out = []
    for a, b in zip([0, *starts], [*starts, len(lines)]) if starts else ():
        body, name = "\n".join(lines[a:b]), _BEGINS.match(lines[a])
        if len(body.strip()) >= LEAST:
            out.append((name.group(1) if name else "block", a + 1, b, body))
    return out


def split_by_size(text: str, size: int = SIZE) -> list[tuple[int, int, str]]:
    """(first line, last line, body); the next piece begins up to ``OVERLAP_LINES`` lines back."""
    lines = text.split("\n")
    out, start = [], 0
    while start < len(lines):
        end, n = start, 0
        while end < len(lines) and (end == start or n + len(lines[end]) + 1 <= size):
            n += len(lines[end]) + 1
            end += 1
        body = "\n".join(lines[start:end])
        if len(body) >= LEAST:
            out.append((start + 1, end, body))
        if end >= len(lines):
            break
        start = max(end - min(OVERLAP_LINES, (end - start) // 4), start + 1)
    return out


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            for r in split_by_size(t):
                at.append(i)
                rows.append(r)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string())))], names=["key", "first_line", "last_line", "body"])


def size_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(_sized, f"key {kind}, first_line int, last_line int, body string").withColumnRenamed("key", key)
