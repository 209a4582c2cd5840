"""Files that were not written by hand for their repository.

Every chunk is read once. Its leading comments, the shapes of its lines and its
dense long lines tell generated, minified and data files. Its normalised token
stream (comments and string contents dropped, names kept, numbers as one token)
is fingerprinted by winnowing. Two files are alike if they have ``SHARED`` of the
fingerprints of either in common, all of them counted, so a small file is not like a
large one that holds it, nor a large one like the file whose function it copied. A
file with files like it of ``OWNERS`` unrelated owners, its own included, is a
vendored copy, whatever it is called and whatever it says. Repositories of one owner
are related. Copies too rare to recur are told by what their leading comment or the
directory they are kept in says.

Files that are alike have a fingerprint in common even among the rarest of each, as
many as leave too few for ``SHARED``; only files that meet there are compared, first
with their ``NEAR`` neighbours by size. What that leaves undecided is compared with
all files it meets of owners not yet found, so that no pair is left out and many
copies of one file do not all meet each other. Of owners no more than ``OWNERS`` are
kept where their number decides.

Defined results: null ``repo`` or ``file`` make no file; null and empty code and
``block`` chunks (configuration) count nothing; rows delivered twice count once,
because shapes are taken per distinct chunk; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treadle.llm.near_dup import _A, _C, _Hashes, mix
from treadle.session import cut, table

#: Tokens of a fingerprint, and the window of fingerprints of which the least is kept.
KMER, WINDOW = 8, 6
#: Permutations of ``minima``.
MINIMA = 64
#: Unrelated owners, the file's own included, that have files alike, and the share in common of the fingerprints of either.
OWNERS, SHARED = 3, 0.6
#: Neighbours that a file is compared with first, of those it meets by one fingerprint.
NEAR = 4
#: A file needs so many fingerprints to be judged by them.
LEAST_PRINTS = 4
#: Share of lines of one shape, and the least number of lines, of generated tables and data.
SHAPE_SHARE, SHAPE_LINES = 0.55, 10
#: Length of a long line, the share of white space up to which it is dense, and the share of a file that is so.
LONG, DENSE, DENSE_SHARE = 200, 0.1, 0.5

_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|<!--)")
_BLOCK = re.compile(r"\s*(/\*|<!--)")
_CLOSE = {"/*": "*/", "<!--": "-->"}
#: Said of the file itself, at the start of a leading comment line.
_GENERATED = re.compile(
    r"^\W*(?:auto-?generated\b|@generated\b|(?:this|the) (?:file|code|module|class) (?:was|is|has been) (?:\w+ )?(?:automatically|auto-?generated|generated|produced|created by)"
    r"|(?:code |file |source )?generated (?:automatically |code )?(?:by|from|with)\b|automatically generated|machine generated|<auto-generated"
    r"|diese datei wurde (?:maschinell|automatisch)|ce fichier (?:a été|est) (?:généré|produit)|este archivo (?:fue|ha sido|es) generado|do not (?:edit|modify)\b)",
    re.I | re.M,
)
_VENDORED = re.compile(
    r"^\W*(?:(?:copied|taken|imported|vendored|adapted|downloaded)(?: verbatim| unmodified| unchanged)? (?:from|snapshot of)\b(?=.*\b(?:upstream|project|library|release|version|revision|tag)\b)"
    r"|imported snapshot of\b|(?:this|the) (?:file|directory) is (?:a )?(?:vendored|third[- ]party|part of the \w+ (?:library|project))"
    r"|\S+ v?\d+\.\d+(?:\.\d+)? (?:\(c\)|©|copyright)|.*\bmaintained upstream\b)",
    re.I | re.M,
)
#: Directories that package managers and habit keep third-party copies in, and names that generators and bundlers give.
VENDOR_DIR = r"(?i)(^|/)_?(vendor|vendored|third[-_]?party|external|externals|node_modules|bower_components)/"
GENERATED_NAME = r"(?i)(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h)|[._-]generated\.\w+|\.g\.\w+|(^|/)generated/[^/]+)$"
MINIFIED_NAME = r"(?i)([.-]min|\.bundle)\.(js|mjs|css)$"
_BANNER = re.compile(r"\s*/\*!")
_STRING = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_LINE_STRING = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'')
_NUMBER = re.compile(r"\b0x[0-9a-fA-F]+\b|\b\d[\d.]*\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_LINE_COMMENT = re.compile(r"(?m)(?:^|\s)(?://|#).*$|/\*[\s\S]*?\*/")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]").findall


def leading_comment(code: str) -> str:
    """The comment lines at the top of a text, to the end of the comment."""
    out, at, until = [], 0, ""
    while at < len(code):
        end = code.find("\n", at) % (len(code) + 1)
        line, at = code[at:end], end + 1
        if until or _COMMENT.match(line):
            out.append(line)
            rest = line
            # whether a block comment goes on below
            while m := (until or _BLOCK.match(rest)):
                if not until:
                    until, rest = _CLOSE[m.group(1)], rest[m.end() :]
                before, closed, rest = rest.partition(until)
                if not closed:
                    break
                until = ""
        elif line.strip():
            break
    return "\n".join(out)


def shape(line: str) -> str:
    """A line without its names, numbers and strings; comments are one shape of their own each."""
    s = _LINE_STRING.sub("S", line.strip())
    return _NAME.sub("W", _NUMBER.sub("0", s))


def shapes(code: str) -> tuple[int, int, int, int]:
    """(lines, lines of the most common shape, characters, characters in dense long lines)."""
    count: Counter = Counter()
    lines = dense = 0
    for line in code.split("\n"):
        s = line.strip()
        if not s or s in "{}();]},":
            continue
        lines += 1
        if len(s) > LONG:
            if sum(map(s.count, " \t")) < DENSE * len(s):
                dense += len(s)
            continue
        if not _COMMENT.match(s):
            count[shape(s)] += 1
    return lines, max(count.values(), default=0), len(code), dense


def fingerprints(code: str, memo: dict) -> np.ndarray:
    """Winnowed fingerprints of the normalised tokens, distinct."""
    bare = _LINE_COMMENT.sub(" ", _STRING.sub(" S ", code))
    t = np.array([memo["0" if x[0].isdigit() else x] for x in _TOKEN(bare)], np.uint64)
    if len(t) < KMER:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(t) - KMER + 1, np.uint64)
    for i in range(KMER):
        h = mix(h * _C + t[i : len(t) - KMER + 1 + i])
    if len(h) > WINDOW:
        w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        h = h[w.argmin(axis=1) + np.arange(len(w))]
    return np.unique(h)


_SEEDS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * _A)


def minima(prints: np.ndarray) -> np.ndarray:
    """The least of the fingerprints under each permutation, as signed numbers; the greatest number of none."""
    if not len(prints):
        return np.full(MINIMA, 2**63 - 1)
    return mix(prints[:, None] ^ _SEEDS).view(np.int64).min(axis=0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Hashes()
    for batch in batches:
        rows, prints = [], []
        for code in batch.column("code").to_pylist():
            head = leading_comment(code)
            n, top, chars, dense = shapes(code)
            rows.append((bool(_GENERATED.search(head)), bool(_VENDORED.search(head)), bool(_BANNER.match(code)) and dense > 0, n, top, chars, dense))
            prints.append(fingerprints(code, memo))
        cols = [batch.column(c) for c in ("repo", "file", "chunk_no", "first")]
        kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        cols += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        sizes = [len(found) for found in prints]
        cols.append(pa.array(sizes, pa.int32()))
        cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *prints]).view(np.int64))))
        yield pa.RecordBatch.from_arrays(cols, names=["repo", "file", "chunk_no", "first", "generated", "vendored", "banner", "lines", "top", "chars", "dense", "prints", "found"])


def copied_files(files: DataFrame) -> DataFrame:
    """``(f, copied)`` of the files ``(f, owner, minima)`` of whose minima most recur with ``OWNERS`` owners; an estimate that no query uses."""
    keys = files.select("f", "owner", F.posexplode("minima").alias("i", "m")).select("f", "owner", F.xxhash64("i", "m").alias("key"))
    often = keys.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("owners")).where(F.col("owners") >= OWNERS).select("key")
    shared = keys.select("f", "key").join(often, "key", "left_semi").groupBy("f").agg(F.count("*").alias("n"))
    return shared.where(F.col("n") >= MINIMA * SHARED).select("f", F.lit(True).alias("copied"))


def _owners(c):
    """The least ``OWNERS`` of the distinct owners of a group: whether there are so many stays exact when such lists are united."""
    return F.slice(F.array_sort(F.collect_set(c)), 1, OWNERS)


def copies(files: DataFrame) -> DataFrame:
    """``(f, copied)`` of the files ``(f, owner, found)`` that are like files of ``OWNERS`` owners, their own included."""
    need = F.ceil(F.col("n") * SHARED)
    keys = files.select("f", "owner", F.explode("found").alias("x"))
    often = keys.groupBy("x").agg(F.count("*").alias("often"), F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi").select("x", "often")
    of = keys.select("f", "x").join(often, "x").groupBy("f").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("s"))
    shared = files.select("f", "owner", F.size("found").alias("n")).join(of, "f").where(F.size("s") >= need).select("f", "owner", "n", F.col("s.x").alias("s"))
    # files with the same fingerprints are one class; what one owner alone has counts by its number only
    shared = cut(shared.withColumn("c", F.xxhash64("n", "s", F.when(F.size("s") < F.col("n"), F.col("owner")))))
    classes = cut(shared.groupBy("c").agg(F.first("n").alias("n"), F.first("s").alias("s"), _owners("owner").alias("owners")))

    # fingerprints of one owner alone are the rarest, so they come before those of ``s``
    rows = classes.select("c", "n", "owners", F.size("s").alias("m"), F.posexplode(F.slice("s", 1, F.size("s") - need.cast("int") + 1)).alias("i", "x"))
    rows = rows.withColumn("rest", F.col("m") - F.col("i")).drop("m", "i")
    held = rows.select("x", F.explode("owners").alias("o")).groupBy("x").agg(_owners("o").alias("held")).where(F.size("held") > 1)
    rows = rows.join(held, "x")
    reach = rows.select("c", F.explode("held").alias("o")).groupBy("c").agg(F.size(_owners("o")).alias("reach"))
    rows = cut(rows.join(reach, "c").withColumn("open", (F.size("owners") < OWNERS) & (F.col("reach") >= OWNERS)).drop("reach"))

    def alike(pairs: DataFrame) -> DataFrame:
        one, two = classes.select("c", "n", "s"), classes.select(F.col("c").alias("g"), F.col("n").alias("gn"), F.col("s").alias("gs"))
        both = pairs.distinct().join(one, "c").join(two, "g").withColumn("i", F.size(F.array_intersect("s", "gs")))
        return both.where(F.col("i") >= (F.col("n") + F.col("gn") - F.col("i")) * SHARED).select("c", "g")

    def known(similar: DataFrame) -> DataFrame:
        of = similar.join(classes.select(F.col("c").alias("g"), F.explode("owners").alias("o")), "g").select("c", "o")
        return of.union(classes.select("c", F.explode("owners").alias("o"))).groupBy("c").agg(_owners("o").alias("known"))

    # two files have no more in common than either has from the first on at which they meet
    most = F.least("rest", "grest")
    sizes = (F.col("gn") >= F.col("n") * SHARED) & (F.col("n") >= F.col("gn") * SHARED) & (most >= (F.col("n") + F.col("gn") - most) * SHARED)
    w = Window.partitionBy("x").orderBy("n", "c")
    next_ones = F.array(*(F.lead(F.struct("c", "n", "owners", "open", "rest"), i).over(w) for i in range(1, NEAR + 1)))
    near = rows.withColumn("next", next_ones).select("c", "n", "owners", "open", "rest", F.explode("next").alias("r")).where("r is not null")
    near = near.select("c", "n", "owners", "open", "rest", *(F.col(f"r.{a}").alias(b) for a, b in (("c", "g"), ("n", "gn"), ("owners", "go"), ("open", "gopen"), ("rest", "grest"))))
    near = near.where((F.col("open") | F.col("gopen")) & (F.size(F.array_union("owners", "go")) > 1) & sizes)
    first = cut(alike(near.select("c", "g")))
    first = first.union(first.select(F.col("g").alias("c"), F.col("c").alias("g")))
    so_far = cut(known(first))

    left = rows.where("open").join(so_far, "c").where((F.size("known") < OWNERS) & (F.size(F.array_except("held", "known")) > 0)).select("x", "c", "n", "rest", "known")
    others = left.join(rows.select("x", *(F.col(a).alias(b) for a, b in (("c", "g"), ("n", "gn"), ("owners", "go"), ("rest", "grest")))), "x")
    others = alike(others.where((F.col("c") != F.col("g")) & sizes & (F.size(F.array_except("go", "known")) > 0)).select("c", "g"))
    found = known(first.union(others)).where(F.size("known") >= OWNERS).select("c")
    return shared.join(found, "c").select("f", F.lit(True).alias("copied"))


def file_judgements(chunks: DataFrame) -> DataFrame:
    """``(repo, file, generated, minified, data, vendored)`` of each source file."""
    # classes hold the code of their members; top-level chunks make up the file
    rows = chunks.where(
        "repo is not null and file is not null and code is not null and code <> '' and coalesce(chunk_type, '') <> 'block' and coalesce(parent, '') = ''"
    ).select("repo", "file", "chunk_no", (F.coalesce("start_line", F.lit(1)) <= 3).alias("first"), "code")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"repo {types['repo']}, file {types['file']}, chunk_no {types['chunk_no']}, first boolean, generated boolean, vendored boolean, banner boolean, lines long, top long, chars long, dense long, prints int, found array<long>"
    seen = cut(rows.mapInArrow(_features, schema))
    owner = F.lower(F.regexp_replace("repo", "__.*", ""))

    one = seen.dropDuplicates(["chunk_no"]).groupBy("repo", "file").agg(
        F.max(F.col("generated") & F.col("first")).alias("generated"), F.max(F.col("vendored") & F.col("first")).alias("said"), F.max("banner").alias("banner"),
        F.sum("lines").alias("lines"), F.sum("top").alias("top"), F.sum("chars").alias("chars"), F.sum("dense").alias("dense"), F.sum("prints").alias("prints"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
    )
    one = cut(one.withColumn("f", F.xxhash64("repo", "file")))
    share = copies(one.where(F.col("prints") >= LEAST_PRINTS).select("f", F.xxhash64(owner).alias("owner"), "found"))
    dense = F.col("dense") > F.col("chars") * DENSE_SHARE
    tabular = (F.col("lines") >= SHAPE_LINES) & (F.col("top") >= F.col("lines") * SHAPE_SHARE)
    return one.join(share, "f", "left").select(
        "repo", "file", (F.col("generated") | F.col("file").rlike(GENERATED_NAME)).alias("generated"),
        (dense | F.col("banner") | F.col("file").rlike(MINIFIED_NAME)).alias("minified"), tabular.alias("data"),
        (F.col("said") | F.col("file").rlike(VENDOR_DIR) | F.coalesce("copied", F.lit(False))).alias("vendored"), F.col("said").alias("said_vendored"), F.coalesce("copied", F.lit(False)).alias("copied"),
    )


def not_handwritten(chunks: DataFrame) -> DataFrame:
    return file_judgements(chunks).where("generated or minified or data or vendored").select("repo", "file")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "chunks"))


def p2_judgements(spark: SparkSession, d: str) -> DataFrame:
    return file_judgements(table(spark, d, "chunks"))


QUERIES = {"p2_found": p2_found, "p2_judgements": p2_judgements}
SQL: dict[str, str] = {}
