"""Text cut off by field limits or in transfer.

Word trigrams are counted inside texts and at their ends, in SQL over whole texts;
numbers are one word and signs and line ends are words of their own. The trigrams as
they stand are counted once; from their counts follow the words that make up
``KEPT_SHARE`` of a family of texts (so never more than its inverse), and the counts
of trigrams in which all other words are one class. The final trigrams are joined
with both: a text whose last trigram is frequent inside and almost never final is a
candidate; the trigram as it stands decides where it is frequent, else its class. So
are texts of a length (in characters or bytes, a mark aside) that is far more common
in their repository than its neighbours, and texts that end in a mark of
omission.

Candidates are checked against the source file the chunk was taken from: the
code must go on there, or the documentation must go on beside the signature.
Where the source is missing, only strong signs count: the repository's length
together with an unusual end, or brackets left open.

Defined results: null and empty values are never cut; rows delivered twice count
once; of several source rows of one path the longest counts; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.llm.documentation import comment_above, documentation_of
from treadle.session import cut, table

#: A trigram is judged from so many occurrences on, and hardly ever final below this share.
FREQUENT, ALMOST_NEVER = 20, 0.1
#: A length is a limit if so many values have it, and so many times more than the mean of its neighbours.
LIMIT_VALUES, LIMIT_TIMES, NEIGHBOURS = 4, 6, 15
#: Shorter lengths are those of placeholders and separators.
LEAST_LIMIT = 60
#: Candidates up to this number (about 25 MB as keys) are broadcast to the chunks; beyond it both are shuffled.
BROADCAST_ROWS = 250_000
#: Words of a family of texts that stand for themselves in the classes of trigrams.
KEPT_SHARE = 0.01
#: Characters of a text's end that hold its last words, if there are four; otherwise the whole text is searched.
TAIL = 400

#: Words, numbers, line ends and signs.
TOKEN = r"[\p{L}_$][\p{L}\p{N}_$]*|[0-9]+(?:[.][0-9]+)*|\n(?:\s*\n)*|[^\s\p{L}_$]"

MARK = r"\s*(?:…|\.{3}|\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|\[?(?:truncated|cut|snip)\]?|<(?:truncated|snip)>)\s*$"
_MARK = re.compile(MARK, re.I)

#: Every trigram as it stands, with its occurrences and those at the end of a text.
_TRIGRAMS = """
    SELECT family, t1, t2, t3, count(*) AS n, count_if(t4 IS NULL) AS final FROM (
        SELECT family, inline(arrays_zip(tokens, slice(tokens, 2, size(tokens)), slice(tokens, 3, size(tokens)), slice(tokens, 4, size(tokens)))) AS (t1, t2, t3, t4)
        FROM {t} WHERE size(tokens) >= 3)
    WHERE t3 IS NOT NULL GROUP BY family, t1, t2, t3
"""

_VOCABULARY = """
    SELECT family, t1 AS word FROM (SELECT family, t1, sum(n) AS n FROM {g} GROUP BY family, t1)
    JOIN (SELECT family, sum(n) AS total FROM {g} GROUP BY family) USING (family) WHERE n >= {share} * total
"""


def _classed(source: str) -> str:
    """``source`` with the class of each of its three words as ``m1`` to ``m3``."""
    kind = lambda i: f"CASE WHEN v{i}.word IS NOT NULL THEN t{i} WHEN t{i} RLIKE '^[0-9]' THEN '0' WHEN t{i} RLIKE '^[\\\\p{{{{L}}}}_$]' THEN 'w' ELSE t{i} END AS m{i}"
    joins = " ".join(f"LEFT JOIN {{v}} v{i} ON x.family = v{i}.family AND t{i} = v{i}.word" for i in (1, 2, 3))
    return f"SELECT /*+ BROADCAST(v1, v2, v3) */ x.*, {', '.join(map(kind, (1, 2, 3)))} FROM {source} x {joins}"


_CLASSES = f"SELECT family, m1, m2, m3, sum(n) AS n, sum(final) AS final FROM ({_classed('{g}')}) GROUP BY family, m1, m2, m3 HAVING sum(n) >= {{often}}"

_CANDIDATES = f"""
    WITH lengths AS (
        SELECT repo, field, unit, length, count(*) AS n FROM (
            SELECT repo, field, inline(array(struct('chars' AS unit, chars AS length), struct('bytes' AS unit, bytes AS length))) FROM {{e}}) GROUP BY ALL),
    limits AS (
        SELECT repo, field, unit, length FROM (
            SELECT *, sum(n) OVER (PARTITION BY repo, field, unit ORDER BY length RANGE BETWEEN {{k}} PRECEDING AND {{k}} FOLLOWING) - n AS around FROM lengths)
        WHERE length >= {{short}} AND n >= {{least}} AND n * 2 * {{k}} >= {{times}} * around)
    SELECT e.chunk_no, e.field, e.marked, coalesce(r.final < {{never}} * r.n, t.final < {{never}} * t.n, false) AS odd, r.n IS NOT NULL AS as_it_stands,
        c.length IS NOT NULL OR b.length IS NOT NULL AS limited
    FROM ({_classed('{e}')}) e
    LEFT JOIN (SELECT * FROM {{g}} WHERE final > 0 AND n >= {{often}}) r ON e.family = r.family AND e.t1 = r.t1 AND e.t2 = r.t2 AND e.t3 = r.t3
    LEFT JOIN {{c}} t ON e.family = t.family AND e.m1 = t.m1 AND e.m2 = t.m2 AND e.m3 = t.m3
    LEFT JOIN (SELECT * FROM limits WHERE unit = 'chars') c ON e.repo <=> c.repo AND e.field = c.field AND e.chars = c.length
    LEFT JOIN (SELECT * FROM limits WHERE unit = 'bytes') b ON e.repo <=> b.repo AND e.field = b.field AND e.bytes = b.length
"""


def _tokens(text):
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def values_of(chunks: DataFrame) -> DataFrame:
    """``(chunk_no, repo, family, field, txt)`` of all values; languages that end alike are one family."""
    family = F.when(F.col("language") == "python", "python").when(F.col("language").isin("go", "java", "javascript", "typescript"), F.col("language")).otherwise("other")
    rows = chunks.where("chunk_no is not null").select("chunk_no", "repo", family.alias("family"), F.explode(F.array(F.struct(F.lit("code").alias("field"), F.col("code").alias("txt")), F.struct(F.lit("docstring").alias("field"), F.col("docstring").alias("txt")))).alias("x"))
    return rows.select("chunk_no", "repo", F.when(F.col("x.field") == "docstring", "doc").otherwise(F.col("family")).alias("family"), "x.field", "x.txt").where("txt is not null and txt <> ''")


def judged(chunks: DataFrame) -> DataFrame:
    """``(chunk_no, field, marked, odd, as_it_stands, limited)`` of every value."""
    spark = chunks.sparkSession
    values = values_of(chunks)
    text = F.when(F.col("field") == "docstring", F.lower("txt")).otherwise(F.col("txt"))
    grams = cut(spark.sql(_TRIGRAMS, t=values.select("family", _tokens(text).alias("tokens"))))
    # at most 1 / KEPT_SHARE words of each of a fixed number of families
    words = cut(spark.sql(_VOCABULARY, g=grams, share=KEPT_SHARE))
    classes = cut(spark.sql(_CLASSES, g=grams, v=words, often=FREQUENT))
    tail = _tokens(F.substring(text, -TAIL, TAIL))
    last = F.when(F.size(tail) > 3, tail).otherwise(_tokens(text))
    ends = values.select("chunk_no", "field", "family", "repo", F.length("txt").alias("chars"), F.octet_length("txt").alias("bytes"), F.rtrim("txt", F.lit(" \t\r\n")).alias("bare"), last.alias("last"))
    ends = ends.withColumn("marked", F.substring("bare", -32, 32).rlike("(?i)" + MARK)).drop("bare")
    ends = ends.select("chunk_no", "field", "family", "repo", "chars", "bytes", "marked", *(F.try_element_at("last", F.lit(i - 4)).alias(f"t{i}") for i in (1, 2, 3)))
    ends = cut(ends.dropDuplicates(["chunk_no", "field"]))
    return spark.sql(_CANDIDATES, e=ends, g=grams, v=words, c=classes, k=NEIGHBOURS, least=LIMIT_VALUES, short=LEAST_LIMIT, times=LIMIT_TIMES, often=FREQUENT, never=ALMOST_NEVER)


def candidates(judgements: DataFrame) -> DataFrame:
    return judgements.where("marked or odd or limited")


_SKELETON = re.compile(r"[\W_]+")
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/")


def open_brackets(code: str) -> bool:
    s = _STRINGS.sub("", code)
    return any(s.count(a) > s.count(b) for a, b in ("{}", "()", "[]"))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def code_goes_on(code: str, source: str, language: str) -> bool | None:
    """Whether the source continues what ``code`` breaks off; None if it is not there."""
    bare = _MARK.sub("", code)
    at = source.find(code)
    if at < 0:
        at, code = source.find(bare), bare
    if at < 0 or not code.strip():
        return None
    rest = source[at + len(code) :]
    if not rest.strip():
        return False
    if rest[0] != "\n" and not code.endswith("\n") and rest[:2] != "\r\n" and rest.split("\n", 1)[0].strip(" \t\r;,"):
        return True
    first = next(x for x in code.split("\n") if x.strip())
    following = next(x for x in rest.split("\n") if x.strip())
    if _indent(following) > _indent(first):
        return True
    return language in ("go", "java", "javascript", "typescript") and following.lstrip()[0] in "})]" and open_brackets(code)


def doc_goes_on(doc: str, code: str, source: str, language: str) -> bool | None:
    """Whether the documentation beside the signature continues ``doc``; None if it is not there."""
    bare = _MARK.sub("", code)
    at = source.find(code)
    if at < 0 and bare.strip():
        at = source.find(bare)
    if at < 0:
        return None
    have = _SKELETON.sub("", _MARK.sub("", doc))
    if not have:
        return False
    known = None
    before = source[:at].split("\n")
    beside = [comment_above(before, len(before) - 1, language), *documentation_of(source[at:], language)]
    for whole in beside:
        w = _SKELETON.sub("", whole)
        if w.startswith(have):
            return len(w) > len(have)
        if len(have) > 20 and have in w:
            known = len(w) > w.find(have) + len(have)
    return known


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("field", "language", "code", "docstring", "content", "marked", "odd", "limited")
    for batch in batches:
        keep = []
        for field, language, code, doc, source, marked_, odd, limited in zip(*(batch.column(c).to_pylist() for c in names)):
            found = None
            if source:
                found = code_goes_on(code, source, language) if field == "code" else doc_goes_on(doc, code or "", source, language)
            if found is None:
                found = limited and (odd or marked_) or field == "code" and odd and language != "python" and open_brackets(code)
            keep.append(bool(found))
        yield batch.select(["chunk_no", "field"]).filter(pa.array(keep, pa.bool_()))


def truncated(chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """``(chunk_no, field)`` of the values that lack their end."""
    found = cut(candidates(judged(chunks)))
    few = found.count() <= BROADCAST_ROWS
    rows = chunks.where("chunk_no is not null").select("chunk_no", "repo", "file", "language", "code", "docstring")
    wide = rows.join(F.broadcast(found) if few else found, "chunk_no")
    files = wide.select("repo", "file").distinct()
    sources = source_files.where("content is not null and repo is not null").select("repo", F.col("path").alias("file"), "content")
    sources = sources.join(F.broadcast(files) if few else files, ["repo", "file"], "left_semi").groupBy("repo", "file").agg(F.max_by("content", F.length("content")).alias("content"))
    return wide.join(sources, ["repo", "file"], "left").mapInArrow(_check, "chunk_no long, field string").dropDuplicates(["chunk_no", "field"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "chunks"), table(spark, d, "source_files"))


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    """Values and cut values per repository and field."""
    chunks = table(spark, d, "chunks")
    found = truncated(chunks, table(spark, d, "source_files")).withColumn("cut", F.lit(1))
    values = values_of(chunks).select("chunk_no", "repo", "field").distinct()
    return (
        values.join(found, ["chunk_no", "field"], "left").groupBy("repo", "field")
        .agg(F.count("*").alias("n_values"), F.count("cut").alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )


QUERIES = {"p6_found": p6_found, "p6_share": p6_share}
SQL: dict[str, str] = {}
