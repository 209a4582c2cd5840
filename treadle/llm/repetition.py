"""Repetition inside a single document, line by line.

Each line of a text is judged on its own by every rule: how many of its words are
repeated content, whether it ends in punctuation, whether it is navigation, and
whether it is boilerplate. What fails is removed, and a document that loses too much
of its text is rejected. The repetition rule removes of each line the words that are
repeated, the others the whole line. ``p10_found`` are the documents that are rejected
for their losses by the repetition rule alone, ``p10_cleaned`` shows the losses by all
rules. One pass over the text, in Arrow batches; for ``p10_found`` nothing is shuffled.

What is boilerplate is told by phrases and, in ``p10_cleaned``, by the corpus, in any
language: a line (numbers and case aside) of at least ``RECUR_DOCUMENTS`` documents and
``RECUR_SHARE`` of all. Lines are counted by hash, first per task, and looked up by a
join, so that no line is one group.

Words are the maximal runs of Unicode letters and digits in the lower-cased
text. A word is repeated if it lies in a window of five consecutive words whose
same five words also begin earlier in the document; windows run across lines.

Defined results: null, empty and wordless texts have no words and are no cases;
equal rows count once in ``p10_found``; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treadle.session import cut, table

WINDOW = 5
#: A document is rejected if the repetition rule removes this share of its words, in tenths, to compare whole numbers.
TENTHS = 3
#: A line is removed at this share of repeated words.
LINE_SHARE = 0.5
#: A document is rejected if cleaning removes more than this share of its words.
LOSS_SHARE = 0.5

#: Documents that have a line, at least, and their share, from which on it is boilerplate; shorter lines are not counted.
RECUR_DOCUMENTS, RECUR_SHARE, RECUR_WORDS = 10, 0.001, 3

_WORDS = re.compile(r"[^\W_]+").findall
_DIGITS = re.compile(r"\d+").sub
_ENDS = tuple(".!?:;…。！？：；)]}\"'`”»,")
_MENU = re.compile(r"\s[|>»›·](?=\s)")
_NAVIGATION = re.compile(r"^\s*(?:home|next|previous|prev|back|top|menu|skip to|index|contents)\b[^.]{0,30}$", re.I)
_BOILERPLATE = re.compile(r"all rights reserved|copyright \(c\)|©|cookie|terms of (?:use|service)|privacy policy|click here|subscribe|generated by|do not edit|powered by|last (?:updated|modified)", re.I)


def repeated_words(words: list[str], size: int = WINDOW) -> bytearray | None:
    """A mark for each word that is repeated, or None if none is."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return None
    mark, seen, whole = bytearray(len(words)), set(), b"\1" * size
    add = seen.add
    for i, w in enumerate(windows):
        if w in seen:
            mark[i : i + size] = whole
        else:
            add(w)
    return mark


def navigates(line: str) -> bool:
    """Two or more separators between short entries."""
    parts = _MENU.split(line)
    return len(parts) > 2 and max(map(len, parts)) <= 40


def judged_lines(text: str) -> list[tuple[int, int, bool, bool, bool]]:
    """(words, repeated words, lacks punctuation, navigation, boilerplate) of each line."""
    lines = text.split("\n")
    by_line = [_WORDS(x.lower()) for x in lines]
    mark = repeated_words([w for ws in by_line for w in ws])
    out, at = [], 0
    for line, words in zip(lines, by_line):
        n = len(words)
        again = sum(mark[at : at + n]) if mark else 0
        at += n
        end = line.rstrip()
        out.append((n, again, n > 4 and not end.endswith(_ENDS), bool(n and (_NAVIGATION.match(line) or navigates(line))), bool(n and _BOILERPLATE.search(line))))
    return out


def line_keys(text: str) -> list[int | None]:
    """A number for each line, the same for lines that differ in numbers, case and white space only; null for short ones."""
    import xxhash

    out = []
    for line in text.split("\n"):
        words = _WORDS(_DIGITS("0", line.lower()))
        out.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) if len(words) >= RECUR_WORDS else None)
    return out


_LINE = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("repeated", T.IntegerType()), *(T.StructField(c, T.BooleanType()) for c in ("open_end", "navigation", "boilerplate")), T.StructField("key", T.LongType())])


def _judge(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("words", pa.int32()), ("repeated", pa.int32()), ("open_end", pa.bool_()), ("navigation", pa.bool_()), ("boilerplate", pa.bool_()), ("key", pa.int64())])
        for batch in batches:
            lines = [judged_lines(t) if t else [] for t in batch.column(1).to_pylist()]
            totals = [(sum(x[0] for x in ls), sum(x[1] for x in ls)) for ls in lines]
            cols = [batch.column(0), pa.array([a for a, _ in totals], pa.int64()), pa.array([b for _, b in totals], pa.int64())]
            names = ["id", "n_words", "n_repeated"]
            if full:
                names_ = ("words", "repeated", "open_end", "navigation", "boilerplate", "key")
                keyed = (line_keys(t) if t else [] for t in batch.column(1).to_pylist())
                cols.append(pa.array([[dict(zip(names_, (*x, k))) for x, k in zip(ls, ks)] for ls, ks in zip(lines, keyed)], pa.list_(kinds)))
                names.append("lines")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def line_records(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_repeated)``, summed over the judged lines, and, if ``full``, the ``lines`` of each row."""
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = [T.StructField("id", texts.schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType())]
    if full:
        schema.append(T.StructField("lines", T.ArrayType(_LINE)))
    return texts.mapInArrow(_judge(full), T.StructType(schema)).withColumnRenamed("id", doc_id)


def repetitive(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents rejected because the repetition rule removes ``TENTHS`` or more of their words, summed over the judged lines."""
    return line_records(documents, doc_id, full=False).where((F.col("n_words") > 0) & (F.col("n_repeated") * 10 >= F.col("n_words") * TENTHS)).select(doc_id).distinct()


def recurring(records: DataFrame, doc_id: str) -> DataFrame:
    """``(doc_id, recurring)``: the keys of each document's lines that recur in the corpus."""
    keys = records.select(doc_id, F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).where("key is not null").distinct()
    total = records.agg(F.count_distinct(doc_id)).first()[0]
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(RECUR_DOCUMENTS, RECUR_SHARE * total)).select("key")
    return keys.join(often, "key", "left_semi").groupBy(doc_id).agg(F.collect_list("key").alias("recurring"))


def cleaned(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per row: lines, lines that fail each rule, the share of words lost with them, and whether the document is rejected."""
    r = cut(line_records(documents, doc_id))
    again = recurring(r, doc_id).withColumnRenamed(doc_id, "_of")
    r = r.join(again, r[doc_id] == again["_of"], "left").drop("_of")
    common = lambda x: F.coalesce(F.array_contains("recurring", x["key"]), F.lit(False))
    fixed = lambda x: F.struct(*(x[c].alias(c) for c in ("words", "repeated", "open_end", "navigation")), (x["boilerplate"] | common(x)).alias("boilerplate"))
    r = r.withColumn("lines", F.transform("lines", fixed))
    bad = lambda x: (x["words"] > 0) & ((x["repeated"] >= x["words"] * LINE_SHARE) | x["open_end"] | x["navigation"] | x["boilerplate"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["words"])
    r = r.withColumn("lost", total(F.filter("lines", bad)))
    count = lambda f: F.size(F.filter("lines", f))
    return r.select(
        doc_id, "n_words", "n_repeated", F.size("lines").alias("n_lines"), count(bad).alias("n_removed"),
        count(lambda x: (x["words"] > 0) & (x["repeated"] >= x["words"] * LINE_SHARE)).alias("n_repeating"),
        count(lambda x: x["open_end"]).alias("n_open_end"), count(lambda x: x["navigation"]).alias("n_navigation"), count(lambda x: x["boilerplate"]).alias("n_boilerplate"),
        F.round(F.when(F.col("n_words") > 0, F.col("lost") / F.col("n_words")).otherwise(0.0), 6).alias("lost_share"),
        (F.col("lost") > F.col("n_words") * LOSS_SHARE).alias("rejected"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive(table(spark, d, "documents"))


def p10_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(table(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_cleaned": p10_cleaned}
SQL = {
    "p10_found": r"""
with d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
f as (select doc_id, unnest([{'i': i, 'five': w[i:i+4]} for i in range(1, len(w) - 3)]) x from d where len(w) > 4),
again as (select doc_id, x.i i, row_number() over (partition by doc_id, x.five order by x.i) r from f),
marked as (select distinct doc_id, i + unnest(range(0, 5)) as k from again where r > 1),
n as (select doc_id, count(*) n from marked group by doc_id)
select distinct doc_id from n join d using (doc_id) where n * 10 >= len(w) * 3""",
}
