"""Near-duplicate code by Order MinHash.

Tokens are the maximal runs of ASCII letters, digits and ``_``; k-mers are the
runs of three tokens, each labelled by its occurrence, of which only the first
counts because similarity is defined over distinct k-mers. A sketch takes, for
each of ``SKETCHES`` permutations, the three least k-mers and keeps them in the
order they have in the text; two codes meet where a sketch is equal, so that
edits that keep the order weigh less than reordering.

K-mers in more than ``HEAVY`` of all codes would make unrelated codes meet. They
are counted in one pass over all rows (each task reports what is frequent in its
part; the ``HEAVY_MAX`` most frequent are kept, 512 KB at most) and are not
sampled; codes of which they are more than ``MIXED_SHARE`` get further sketches, of
four k-mers, over all of theirs, so that edited copies on a template that much of a
corpus shares are found as well. Up to ``HEAVY_SHARE`` only sketches with a k-mer
that is not frequent count, as the template alone makes no pair.

Codes with equal k-mer sets form a class; each task emits the sketches of a class
once (it remembers the classes of its own part only). Sketches that one class has
alone are left out after one shuffle; the others meet with the parity sketch of
their class, a bitmap in which each k-mer flips one bit. Two such bitmaps differ in
at most as many bits as there are k-mers in one code only, so that pairs too far
apart are dropped where they meet, and never one that is close enough. A sketch of
more than ``HOT_CLASSES`` classes is split into blocks that meet in pairs.

A banded alignment of the two k-mer sequences gives a lower bound of what they
share, which settles most pairs; the others are settled by the exact intersection.

Defined results: null, empty and short codes (under ``MIN_KMERS`` distinct
k-mers) have no duplicates; rows delivered twice count once; a null ``repo`` or
``file`` is a value of its own; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treadle.operators.components import connected_components
from treadle.session import cut, table

MIN_KMERS = 40
#: The threshold as a fraction, compared in whole numbers.
NUM, DEN = 3, 5
SKETCHES = 48
#: Sketches of four over all k-mers, for codes of which more than ``MIXED_SHARE`` is heavy; those
#: of heavy k-mers only count for codes of which more than ``HEAVY_SHARE`` is heavy.
HEAVY_SKETCHES = 48
MIXED_SHARE = 0.15
HEAVY_SHARE = 0.4
#: K-mers of more codes than this share, and of ``HEAVY_LEAST`` at least, are heavy.
HEAVY = 0.0003
HEAVY_LEAST = 20
HEAVY_MAX = 65_536
#: Longs of a parity sketch: about as many bits as four times the k-mers, so that a power of two of them.
PARITY_LEAST, PARITY_MOST = 8, 1024
#: Classes of one sketch that meet in one block.
HOT_CLASSES = 2_000

_TOKENS = re.compile(r"[A-Za-z0-9_]+").findall
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, token):
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def kmers(codes: list, memo: dict, least: int = MIN_KMERS):
    """Distinct k-mers in text order of each code that has at least ``least``:
    hashes, the codes' indexes, and where each begins."""
    arrays, which = [], []
    for i, c in enumerate(codes):
        if c:
            t = [memo[x] for x in _TOKENS(c)]
            if len(t) >= least + 2:
                arrays.append(np.array(t, np.uint64))
                which.append(i)
    if not arrays:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    t = np.concatenate(arrays)
    lens = np.array([len(a) for a in arrays])
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    keep = np.ones(len(t), bool)
    keep[ends - 1] = keep[ends - 2] = False
    keep[-2:] = False
    g = np.zeros(len(t), np.uint64)
    g[:-2] = mix(t[:-2] * _A + t[1:-1] * _B + t[2:] * _C)
    g, doc = g[keep], doc[keep]
    # first occurrences: sort by code and hash, the least position of each run
    key = mix(g + doc * _B)
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.sort(order[np.concatenate([[True], s[1:] != s[:-1]])])
    g, doc = g[first], doc[first].astype(np.int64)
    n = np.bincount(doc, minlength=len(lens))
    good = n >= least
    g = g[good[doc]]
    return g, np.array(which)[good], np.concatenate([[0], np.cumsum(n[good])])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """K-mers in two and at least half of ``HEAVY`` of the codes of this task, and the number of codes as k-mer null."""
    memo, parts, codes = _Hashes(), [], 0
    hs, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def fold():
        nonlocal hs, ns, parts
        h = np.concatenate([hs, *parts])
        w = np.concatenate([ns, np.ones(len(h) - len(hs), np.int64)])
        u, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, w, len(u)).astype(np.int64)
        keep = n >= np.maximum(2, HEAVY * codes / 2)
        hs, ns, parts = u[keep], n[keep], []

    for batch in batches:
        g, which, _ = kmers(batch.column(0).to_pylist(), memo)
        codes += len(which)
        parts.append(g)
        if sum(map(len, parts)) > 2_000_000:
            fold()
    fold()
    keep = ns >= max(2, HEAVY * codes / 2)
    hs, ns = hs[keep], ns[keep]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hs, np.uint64(0)).view(np.int64), mask=np.append(np.zeros(len(hs), bool), True)), pa.array(np.append(ns, codes))], names=["h", "n"])


def heavy_kmers(codes: DataFrame) -> np.ndarray:
    """The most frequent k-mers of all codes, ``HEAVY_MAX`` at most."""
    counts = codes.mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = (counts.where("h is null").first() or (None, 0))[1]
    top = counts.where(F.col("h").isNotNull() & (F.col("n") >= max(HEAVY_LEAST, HEAVY * total))).orderBy(F.col("n").desc(), "h").limit(HEAVY_MAX)
    # never through a column with nulls: that would make the hashes floats
    return np.sort(top.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _padded(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of similar length as rows of one matrix: their numbers, the positions, and what is padding."""
    n = np.diff(starts)
    width_class = np.ceil(np.log(n) * 4)
    for c in np.unique(width_class):
        rows = np.flatnonzero(width_class == c)
        column = np.arange(n[rows].max())
        padding = column >= n[rows][:, None]
        yield rows, np.where(padding, 0, starts[rows][:, None] + column), padding


def sketches(g: np.ndarray, starts: np.ndarray, count: int, take: int, salt: int, light: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each segment and permutation of its ``take`` least k-mers in text order, and whether one of them is ``light``."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * _A + np.uint64(salt))
    out = np.zeros((len(starts) - 1, count), np.uint64)
    some = np.ones(out.shape, bool)
    most = np.uint64(2**64 - 1)
    for rows, at, padding in _padded(starts):
        values, line = g[at], np.arange(len(rows))
        for b in range(count):
            h = mix(values ^ seeds[b])
            h[padding] = most
            least = np.zeros((len(rows), take), np.int64)
            for c in range(take):
                least[:, c] = h.argmin(axis=1)
                h[line, least[:, c]] = most
            p = at[line[:, None], np.sort(least, axis=1)]
            x = np.full(len(rows), seeds[b])
            for c in range(take):
                x = mix(x * _C + g[p[:, c]])
            out[rows, b] = x
            if light is not None:
                some[rows, b] = light[p].any(axis=1)
    return out, some


def parity(g: np.ndarray, starts: np.ndarray, longs: int) -> np.ndarray:
    """A bitmap of ``longs`` longs of each segment, in which each value flips one bit.

    The upper half of a bitmap folded on its lower half is the bitmap of half the size.
    """
    rows, width = len(starts) - 1, 64 * longs
    doc = np.repeat(np.arange(rows), np.diff(starts))
    flips = np.bincount(doc * width + (mix(g ^ _C) % np.uint64(width)).astype(np.int64), minlength=rows * width)
    return np.packbits((flips & 1).astype(np.uint8).reshape(rows, width), axis=1).view(np.int64)


def parity_longs(n: np.ndarray) -> np.ndarray:
    """Longs of the parity sketch of a code with ``n`` k-mers, a power of two."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) / 16)), PARITY_LEAST, PARITY_MOST).astype(np.int64)


def _parities(g: np.ndarray, starts: np.ndarray) -> pa.Array:
    n = np.diff(starts)
    longs = parity_longs(n)
    out: list = [None] * len(n)
    doc = np.repeat(np.arange(len(n)), n)
    for size in np.unique(longs):
        rows = np.flatnonzero(longs == size)
        for i, p in zip(rows, parity(g[(longs == size)[doc]], np.concatenate([[0], np.cumsum(n[rows])]), int(size))):
            out[i] = p
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(longs)]), pa.int32()), pa.array(np.concatenate(out)))


def _sketch(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, emitted = _Hashes(), set()
        for batch in batches:
            g, which, starts = kmers(batch.column("code").to_pylist(), memo)
            n = np.diff(starts)
            if not len(n):
                continue
            doc = np.repeat(np.arange(len(n)), n)
            at = np.searchsorted(heavy, g)
            is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == g if len(heavy) else np.zeros(len(g), bool)
            n_light = np.bincount(doc[~is_heavy], minlength=len(n))
            has = n_light >= 3
            own = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            if has.any():
                bands, _ = sketches(g[~is_heavy & has[doc]], np.concatenate([[0], np.cumsum(n_light[has])]), SKETCHES, 3, 0)
                own.append((np.repeat(np.flatnonzero(has), SKETCHES), bands.ravel()))
            mixed = n - n_light > MIXED_SHARE * n
            if mixed.any():
                of = mixed[doc]
                more, some = sketches(g[of], np.concatenate([[0], np.cumsum(n[mixed])]), HEAVY_SKETCHES, 4, 7, ~is_heavy[of])
                some |= (n - n_light > HEAVY_SHARE * n)[mixed][:, None]
                own.append((np.repeat(np.flatnonzero(mixed), some.sum(axis=1)), more[some]))
            at, flat = map(np.concatenate, zip(*own))
            flat, width = flat[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(n))
            i64 = lambda x: pa.array(x.view(np.int64))
            s1, s2 = (np.add.reduceat(mix(g ^ k), starts[:-1]) for k in (_A, _B))
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(zip(s1.tolist(), s2.tolist())):
                if c not in emitted:
                    emitted.add(c)
                    fresh[i] = True
            keep_k, keep_b = fresh[doc], np.repeat(fresh, width)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n * fresh)]), pa.int32()), pa.array(g[keep_k].astype(np.uint32).view(np.int32)))
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width * fresh)]), pa.int32()), i64(flat[keep_b]))
            take = pa.array(which)
            kept = np.flatnonzero(fresh)
            bitmaps = _parities(g[keep_k], np.concatenate([[0], np.cumsum(n[kept])])) if len(kept) else pa.array([], pa.list_(pa.int64()))
            at = np.cumsum(fresh) - 1
            bitmaps = bitmaps.take(pa.array(at, mask=~fresh))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(take) for c in ("chunk_no", "repo", "file")),
                    i64(s1), i64(s2), pa.array(n.astype(np.int32)),
                    sets, keys, bitmaps,
                ],
                names=["chunk_no", "repo", "file", "s1", "s2", "n", "kmers", "bands", "parity"],
            )

    return run


def aligned(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose partners lie within ``band`` of the diagonal."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    window = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        m = at.get(x)
        if m:
            m &= window << (j - band) if j > band else window >> (band - j)
            u = free & m
            free = ((free + u) | (free - u)) & full
    return len(a) - free.bit_count()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist()):
            n = len(a) + len(b)
            # shared / (n - shared) >= NUM / DEN
            s = aligned(a, b, 48 + abs(len(a) - len(b)))
            keep.append(s * (NUM + DEN) >= NUM * n or len({*a} & {*b}) * (NUM + DEN) >= NUM * n)
        yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep))


def sketched(chunks: DataFrame) -> DataFrame:
    """Each chunk that is long enough with its class, k-mers and sketches."""
    heavy = heavy_kmers(chunks.select("code"))
    rows = chunks.where("chunk_no is not null").select("chunk_no", "repo", "file", "code")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"chunk_no {types['chunk_no']}, repo {types['repo']}, file {types['file']}, s1 long, s2 long, n int, kmers array<int>, bands array<long>, parity array<long>"
    return cut(rows.mapInArrow(_sketch(heavy), schema))


def _apart(a, b):
    """Bits in which two parity sketches differ; the longer one is folded to the length of the other."""

    def folded(x, y):
        half = F.size(x) / 2
        return F.when(F.size(x) > F.size(y), F.transform(F.slice(x, 1, half.cast("int")), lambda v, i: v.bitwiseXOR(F.element_at(x, (i + half + 1).cast("int"))))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v)


def candidates(s: DataFrame) -> DataFrame:
    """Pairs ``(a1, b1)`` of first halves of class numbers that share a sketch and are not too far apart."""
    # one shuffle; the copies of a class that several tasks have emitted are dropped after it
    keys = s.select("s1", F.explode("bands").alias("key")).repartition("key").dropDuplicates(["key", "s1"])
    keys = keys.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
    about = s.where("size(kmers) > 0").dropDuplicates(["s1"]).select("s1", "n", "parity")
    members = keys.join(about, "s1").withColumn("blocks", F.ceil(F.col("m") / HOT_CLASSES).cast("int")).drop("m")
    block = F.pmod(F.xxhash64("s1", "key"), F.col("blocks")).cast("int")
    each = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    side = lambda x, at: members.select("key", F.explode(F.transform(each, at)).alias("meet"), F.col("s1").alias(f"{x}1"), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    a = side("a", lambda i: block * F.col("blocks") + i)
    b = side("b", lambda i: i * F.col("blocks") + block)
    sized = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    # similarity of NUM / DEN leaves (DEN - NUM) / (DEN + NUM) of both for what only one of them has
    close = _apart(F.col("pa"), F.col("pb")) * (DEN + NUM) <= (F.col("na") + F.col("nb")) * (DEN - NUM)
    return a.join(b, ["key", "meet"]).where((F.col("a1") < F.col("b1")) & sized).where(close).select("a1", "b1").distinct()


def class_links(s: DataFrame) -> DataFrame:
    """Pairs of classes ``(a1, a2, b1, b2)`` that are similar and not equal, each once."""
    pairs = cut(candidates(s))
    nodes = pairs.select(F.col("a1").alias("s1")).unionByName(pairs.select(F.col("b1").alias("s1"))).distinct()
    sets = s.where("size(kmers) > 0").select("s1", "s2", "kmers").join(nodes, "s1", "left_semi").dropDuplicates(["s1", "s2"])
    wide = pairs.join(sets.toDF("a1", "a2", "ka"), "a1").join(sets.toDF("b1", "b2", "kb"), "b1")
    return wide.select("a1", "a2", "b1", "b2", "ka", "kb").mapInArrow(_verify, "a1 long, a2 long, b1 long, b2 long")


def near_duplicates(chunks: DataFrame) -> DataFrame:
    """``(chunk_no_a, chunk_no_b)`` of all pairs of different files whose similarity reaches the threshold."""
    s = sketched(chunks)
    links = class_links(s)
    members = s.select("s1", "s2", "chunk_no", "repo", "file").dropDuplicates(["chunk_no"])
    side = lambda x: members.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("chunk_no").alias(f"no_{x}"), F.struct("repo", "file").alias(f"at_{x}"))
    apart = ~F.col("at_a").eqNullSafe(F.col("at_b"))
    across = links.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).where(apart)
    within = side("a").join(side("b"), (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).where(apart & (F.col("no_a") < F.col("no_b")))
    return across.select("no_a", "no_b").unionByName(within.select("no_a", "no_b")).select(F.least("no_a", "no_b").alias("chunk_no_a"), F.greatest("no_a", "no_b").alias("chunk_no_b"))


def duplicate_groups(chunks: DataFrame) -> DataFrame:
    """``(chunk_no, class_no, n_links, group_no)`` of each chunk that is long enough.

    ``class_no`` is the least chunk of those with equal k-mers, ``n_links`` the
    number of other classes the class is similar to, ``group_no`` the least
    chunk of the classes connected by links.
    """
    s = sketched(chunks)
    members = s.select("s1", "s2", "chunk_no").dropDuplicates(["chunk_no"])
    classes = cut(members.groupBy("s1", "s2").agg(F.min("chunk_no").alias("class_no")))
    links = class_links(s).join(classes.toDF("a1", "a2", "a"), ["a1", "a2"]).join(classes.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    links = cut(links)
    degree = links.select(F.col("a").alias("class_no")).unionByName(links.select(F.col("b").alias("class_no"))).groupBy("class_no").agg(F.count("*").alias("n_links"))
    groups = connected_components(links).select(F.col("node").alias("class_no"), F.col("component").alias("group_no"))
    return (
        members.join(classes, ["s1", "s2"])
        .join(degree, "class_no", "left")
        .join(groups, "class_no", "left")
        .select("chunk_no", "class_no", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_no", "class_no").alias("group_no"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "chunks"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "chunks"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL: dict[str, str] = {}
