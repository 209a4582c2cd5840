"""Encoding of a corpus with a public byte-level BPE vocabulary.

Documents are cut into pre-tokens by the vocabulary's pattern. A block of
documents (``BLOCK_CHARS`` of text) keeps its distinct pre-tokens once and its
documents as positions in them, so that the global shuffle moves each word once
per block instead of once per occurrence. The shuffle by word brings equal words
of all blocks together, where each distinct word is encoded once (once for every
``2 ** SHARING`` tasks of the first pass, in a corpus that has more); its ids go
back to the blocks by their number, and every document is reassembled by
position. Decoding explodes ids by position and joins the table of token bytes.

The path of the vocabulary is a parameter; every executor must see it.

Defined results: empty text gives an empty list, null text gives null; a special
token's name in a text is ordinary text; equal rows give equal rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treadle.session import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern's ``\s`` has it, for engines that count more.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Characters of text whose documents share a dictionary.
BLOCK_CHARS = 8_000_000

#: Tasks whose blocks share the encoding of a word, as a power of two, so that the most
#: frequent word of a large corpus is not one task's.
SHARING = 12

_ENCODERS: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encoder(path: str):
    """The encoder of one pre-token, made once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _ENCODERS[path]


class _Block(dict):
    """Stretches of text to the numbers of their pre-tokens.

    A stretch begins at a single space between two characters that are no white
    space, where a pre-token begins whatever stands around it; so equal
    stretches have equal pre-tokens and are cut by the pattern once.
    """

    def __init__(self, words):
        super().__init__()
        import regex

        self.words: dict[str, int] = {}
        self.cut = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")).findall if words is None else words

    def __missing__(self, stretch):
        n = self.words
        self[stretch] = got = tuple([n.setdefault(w, len(n)) for w in self.cut(stretch)])
        return got


_STRETCH = re.compile(r"(?<=\S)(?= \S)").split
_INT_LIST = pa.list_(pa.int32())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seq, base = 0, TaskContext.get().partitionId() << 32
    block, ids, flat, ends, chars, cutter = None, [], [], [0], 0, None
    valid: list[bool] = []

    def out():
        nonlocal seq
        offsets = pa.array([None if not v else e for v, e in zip(valid, ends)] + [ends[-1]], pa.int32())
        pos = pa.ListArray.from_arrays(offsets, pa.array(np.asarray(flat, np.int32)))
        b, n = base + seq, len(valid)
        seq += 1
        doc = pa.concat_arrays(ids) if ids else None
        yield pa.RecordBatch.from_arrays(
            [pa.array([b] * n, pa.int64()), doc, pos, pa.nulls(n, pa.list_(pa.string()))], names=["block", "id", "pos", "words"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int64()), pa.nulls(1, doc.type), pa.nulls(1, _INT_LIST), pa.array([list(block.words)], pa.list_(pa.string()))],
            names=["block", "id", "pos", "words"],
        )

    for batch in batches:
        texts, at = batch.column(1).to_pylist(), 0
        for i, text in enumerate(texts):
            if block is None:
                block, flat, ends, chars, valid, ids, at = _Block(cutter), [], [0], 0, [], [], i
                cutter = block.cut
            valid.append(text is not None)
            if text:
                for s in _STRETCH(text):
                    flat += block[s]
                chars += len(text)
            ends.append(len(flat))
            if chars >= BLOCK_CHARS:
                ids.append(batch.column(0).slice(at, i + 1 - at))
                yield from out()
                block, at = None, i + 1
        if block is not None:
            ids.append(batch.column(0).slice(at))
    if block is not None and valid:
        yield from out()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last, got = encoder(path).encode_ordinary, None, None
        for batch in batches:
            ids = []
            for w in batch.column(2).to_pylist():  # sorted: equal words follow each other
                if w != last:
                    last, got = w, one(w)
                ids.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, _INT_LIST)], names=["block", "n", "ids"])

    return run


def _positions(docs: pa.Table, words: pa.Table):
    """Documents' positions, and the words' ids by number."""
    words = words.sort_by("n").column("ids").combine_chunks()
    docs = docs.combine_chunks()
    pos = docs.column("pos").combine_chunks() if docs.num_rows else pa.array([], _INT_LIST)
    if isinstance(pos, pa.ChunkedArray):
        pos = pa.concat_arrays(pos.chunks) if pos.num_chunks else pa.array([], _INT_LIST)
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], _INT_LIST)
    lens = np.asarray(words.value_lengths(), np.int64) if len(words) else np.zeros(0, np.int64)
    at = pos.flatten().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pos.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    return docs, pos, words, lens, at, offsets


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    docs, pos, words, lens, at, offsets = _positions(docs, words)
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    flat = words.flatten().to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
    n = lens[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
    edges = ends[offsets]
    mask = np.concatenate([np.asarray(pos.is_null()), [False]])
    ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32(), mask=mask), pa.array(flat[take], pa.int32()))
    return pa.table({"id": docs.column("id"), "ids": ids})


def _lengths(docs: pa.Table, words: pa.Table) -> pa.Table:
    docs, pos, words, lens, at, offsets = _positions(docs, words)
    sums = np.concatenate([[0], np.cumsum(lens[at])])[offsets]
    return pa.table({"id": docs.column("id"), "n": pa.array(np.diff(sums), pa.int64(), mask=np.asarray(pos.is_null()))})


def _assembled(texts: DataFrame, path: str, f, schema: T.StructType) -> DataFrame:
    kind = texts.schema[0].dataType
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", kind), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType()))])
    blocks = cut(texts.mapInArrow(_blocks, out))
    words = blocks.where("words is not null").select("block", F.posexplode("words").alias("n", "word"))
    coded = words.repartition("word", F.shiftright("block", 32 + SHARING)).sortWithinPartitions("word").mapInArrow(_encode(path), "block long, n int, ids array<int>")
    docs = blocks.where("words is null").select("block", "id", "pos")
    return docs.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(f, schema)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of each row."""
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", texts.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _assembled(texts, vocabulary, _assemble, schema).withColumnRenamed("id", doc_id)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n)`` of each row, by the same way without moving the ids."""
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", texts.schema[0].dataType), T.StructField("n", T.LongType())])
    return _assembled(texts, vocabulary, _lengths, schema).withColumnRenamed("id", doc_id)


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, hex)`` of each token; as many rows as the vocabulary has."""
    return spark.createDataFrame([(r, b.hex()) for b, r in ranks(vocabulary).items()], "id int, hex string")


def decode_corpus(encoded: DataFrame, tokens: DataFrame, doc_id: str = "doc_id", run: int = 4096) -> DataFrame:
    """``(doc_id, text)``; ids are joined in runs, so that no document is one group of all its tokens."""
    t = tokens.select(F.col("id").alias("_t"), "hex")
    parts = (
        encoded.where("size(ids) > 0")
        .select(doc_id, F.posexplode("ids").alias("at", "_t"))
        .join(t, "_t")
        .groupBy(doc_id, F.floor(F.col("at") / run).alias("part"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hex"))), lambda x: x["hex"]), "").alias("hex"))
        .groupBy(doc_id)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hex"))), lambda x: x["hex"]), "").alias("hex"))
        .select(doc_id, F.decode(F.unhex("hex"), "UTF-8").alias("text"))
    )
    rest = encoded.where("ids is null or size(ids) = 0").select(doc_id, F.when(F.col("ids").isNotNull(), "").alias("text"))
    return parts.unionByName(rest)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, n_tokens, same)``: whether the decoded ids are the text again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = cut(encode_corpus(docs))
    back = decode_corpus(ids, token_bytes(spark)).withColumnRenamed("text", "back")
    counts = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.join(back, "doc_id").join(counts, "doc_id").select("doc_id", F.when(F.col("back").isNotNull(), F.col("n_tokens")).alias("n_tokens"), F.col("text").eqNullSafe(F.col("back")).alias("same"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL: dict[str, str] = {}
