"""Credentials embedded in source code and configuration.

Literals that stand where a credential would (named so, in a connection string,
a header, a command line) or that have the structure of one (private keys,
signed tokens, prefixed tokens) are indexed corpus-wide with the owners of the
repositories that hold them. Values of ``MAX_OWNERS`` or more owners are
placeholders that people copy, and suppressed; the rest are confirmed.

Every chunk is then scanned again for confirmed values, wherever they stand. No
list of all secrets is broadcast: each value is known by eight bytes in a row of it
(no value is shorter), those that the fewest other values have, so that no anchor
stands for many values; a bitmap of fixed size tells which eight bytes of a chunk, at
any offset, may be such anchors, and only these are joined with the values. An
automaton of the values the chunks of a batch may hold finds their exact occurrences.

Defined results: null and empty code hold nothing; rows delivered twice count
once; a value that occurs several times in a chunk counts once; a null ``repo``
is an owner of its own; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.llm.near_dup import _A, mix
from treadle.session import cut, table

MAX_OWNERS = 6
#: Bits of the bitmap of anchors, and those of each anchor; fixed, whatever the number of values.
ANCHOR_BITS = 1 << 25
PROBES = 3
#: Bytes of text that are searched for anchors at a time.
SPAN = 1 << 18
CONFIG = ("env", "ini", "properties", "toml", "yaml", "json", "xml", "conf", "cfg")
REDACTED = "REDACTED"

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(?:[^-]|-(?!----BEGIN )){32,}?-----END \1PRIVATE KEY-----")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`]*:([^\s@\"'`]+)@[\w.-]")
_USER = re.compile(r"\s(?:-u|--user)[ =][\"']?[^\s:\"'`]+:([^\s\"'`]+)")
_FLAG = re.compile(r"--?(?:[a-z]+-)*(?:password|passwd|passphrase|pass|pwd|secret|token|api-?key|access-?key)[= ]([^\s\"'`]+)", re.I)
_PAIR = re.compile(r"[;\"'`](?:pwd|password|accountkey|sharedaccesskey)=([^;\"'`\s]+)", re.I)
_SCHEME = re.compile(r"\b(?:bearer|basic|token)\s+([A-Za-z0-9._~+/-]{12,}={0,2})", re.I)
_PREFIXED = re.compile(r"(?<![\w.+/-])([a-z]{2,10}\d?(?:[_.-][a-z]{2,10}\d?){0,2}[_.-])([A-Za-z0-9]{20,})(?![\w.+/=-])")
_WORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|tok|key|cred(?:ential)?s?|auth|session|hmac|apikey)"
_NAMED = re.compile(
    r"(?<![\w.])([A-Za-z_][\w.-]*)[\"']?[ \t]*(?::[ \t]*[A-Za-z][\w<>\[\]]*[ \t]*(?==))?(?::=|=>|=|:)[ \t]*(?:[\w.]+\([ \t]*)*(?:b|r|f)?(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`)"
)
_NAMED_BARE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*([^\s\"'`<{\[][^\s]*)[ \t]*$")
_DEFAULT = re.compile(r"[\"']([A-Za-z_][\w.-]*)[\"']\s*,\s*[\"']([^\"'\n]+)[\"']")
_OTHERWISE = re.compile(r"(?<![\w.])([A-Za-z_][\w.]*)(?:[\"']\]|[\"']?\))?[ \t]*(?:\|\||\?\?|\bor\b|\?:)[ \t]*[\"']([^\"'\n]+)[\"']")
_SAID = re.compile(r"(?m)^[ \t]*(?:#|//|\*|--|;|<!--)[^\n]*?\b([A-Za-z_][\w-]*)[ \t]?[=:][ \t]?([^\s\"'`,;()<>{}]+)")
_HAS_WORD = re.compile(_WORD, re.I).search
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+").findall

_SECRET_WORDS = {"password", "passwd", "passphrase", "passcode", "pass", "pwd", "secret", "token", "tok", "apikey", "credential", "credentials", "cred", "creds", "session"}
_KEY_BEFORE = {"api", "access", "secret", "private", "hmac", "signing", "encryption", "auth", "account", "master", "service", "license", "aes", "client", "shared", "deploy"}
_NEVER = {"public", "pub", "min", "max", "length", "ttl", "name", "kind", "type", "masked", "mask", "ref", "hash", "digest", "sha", "checksum", "id", "uuid", "commit", "rev", "revision", "count", "limit", "expiry", "header", "field", "policy", "url", "path", "file"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_]?(?:me|it)|password\d*|secret|token|example.*|dummy.*|sample.*|test(?:ing)?\d*|todo|fixme|none|null|nil|true|false|default|redacted|placeholder.*|your[-_].*|my[-_].*|insert[-_].*|replace[-_]?.*|enter[-_].*|"
    r"set[-_]?me|not[-_]?set|xxx+.*|.*example(?:key)?|(.)\1{3,}|.*\*{3,}.*|.*\.{3,}.*|0123456789.*|1234567\d*|abc123|deadbeef.*|foo(?:bar)?|qwerty\w*)$"
)
#: Values that name where a value is kept: tags, templates, variables, addresses; a sign alone is none.
_REFERENCE = re.compile(
    r"\s|^<[^<>]*>$|[{}<]{2}|[$#%@]\{|^\{[\w.:-]*\}$|^\$\(|^\$[A-Za-z_]\w*$|%\(\w+\)|^%\w+%$|://|^(?:process\.env|os\.environ|os\.getenv|env|config|settings|secrets|vault|ssm|arn)[.:(\[]"
    r"|^@(?:[A-Za-z][\w.]*\(|[a-z]+[:/])|^!(?:[A-Z]?[a-z]+|[A-Z]+)(?:[:/ ]|$)"
)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


def secret_name(name: str) -> bool:
    """Whether a variable or setting of this name holds a credential."""
    words = [w.lower() for w in _SPLIT(name)]
    if not words or words[-1] in _NEVER or "public" in words or "masked" in words:
        return False
    if words[-1] in _SECRET_WORDS or any(words[-1].endswith(w) for w in ("password", "passwd", "apikey", "secret")):
        return True
    return words[-1] in ("key", "keys") and len(words) > 1 and words[-2] in _KEY_BEFORE or words[-1] == "auth"


def plausible(value: str) -> bool:
    """A value that works as written: no placeholder, mask, reference or plain word."""
    if len(value) < 8 or _REFERENCE.search(value) or _PLACEHOLDER.match(value) or _UUID.fullmatch(value):
        return False
    digits = sum(c.isdigit() for c in value)
    if digits == len(value):
        return False
    if digits or re.search(r"[^\w.-]", value):
        return re.search(r"[A-Za-z]", value) is not None
    turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    return turns >= 5 and not re.fullmatch(r"(?:[A-Z]?[a-z]{3,})+", value) or (value.isupper() and value.isalpha() and len(value) in (20, 32, 40))


def _dense(value: str) -> bool:
    """Upper and lower case and digits in a disorder that names do not have."""
    d = sum(c.isdigit() for c in value)
    u = sum(c.isupper() for c in value)
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(value, value[1:]))
    return d >= 1 and u >= 3 and u + d <= len(value) - 2 and turns >= len(value) * 0.35


def literals(code: str, config: bool) -> set[str]:
    """Values of a text that stand or look like credentials."""
    out: set[str] = set()
    for m in _PEM.finditer(code) if "PRIVATE KEY" in code else ():
        out.add(m.group())
    if "eyJ" in code:
        out.update(_JWT.findall(code))
    if "://" in code:
        out.update(v for v in _URL.findall(code) if plausible(v))
    if "-u" in code or "--" in code:
        out.update(v for v in _USER.findall(code) + _FLAG.findall(code) if plausible(v))
    if "=" in code and ";" in code:
        out.update(v for v in _PAIR.findall(code) if plausible(v))
    out.update(v for v in _SCHEME.findall(code) if plausible(v) and any(c.isdigit() for c in v))
    for m in _PREFIXED.finditer(code):
        if _dense(m.group(2)):
            out.add(m.group())
    if _HAS_WORD(code):
        for k, *vs in _NAMED.findall(code):
            if secret_name(k):
                v = vs[0] or vs[1] or vs[2]
                if plausible(v) and "BEGIN" not in v:
                    out.add(v)
        more = _DEFAULT.findall(code) + _SAID.findall(code)
        if "||" in code or "??" in code or "?:" in code or " or " in code:
            more += _OTHERWISE.findall(code)
        for k, v in more:
            if secret_name(k) and plausible(v):
                out.add(v)
        if config:
            for k, v in _NAMED_BARE.findall(code):
                if secret_name(k) and plausible(v) and "BEGIN" not in v:
                    out.add(v)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, values = [], []
        for i, (code, language) in enumerate(zip(batch.column("code").to_pylist(), batch.column("language").to_pylist())):
            for v in literals(code, language in CONFIG):
                at.append(i)
                values.append(v)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("chunk_no").take(take), batch.column("owner").take(take), pa.array(values, pa.string())], names=["chunk_no", "owner", "secret"])


def grams(text: bytes) -> np.ndarray:
    """Each eight bytes in a row, as a number."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    return x


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct eight bytes of each value, with how many bytes of each are the same as another."""
    for batch in batches:
        values, gs, same = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for v in batch.column("secret").to_pylist():
            text = v.encode()
            g, first = np.unique(grams(text), return_index=True)
            w = np.sort(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)[first], axis=1)
            values += [v] * len(g)
            gs.append(g)
            same.append((w[:, 1:] == w[:, :-1]).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(np.concatenate(gs).view(np.int64)), pa.array(np.concatenate(same), pa.int32())], names=["secret", "g", "same"])


def anchored(values: DataFrame) -> DataFrame:
    """``(secret, anchor)``: the eight bytes in a row that the fewest values have, of those the most varied."""
    every = cut(values.mapInArrow(_grams_of, "secret string, g long, same int"))
    often = every.groupBy("g").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", "same", "g"))["g"]
    return every.join(often, "g").groupBy("secret").agg(best.alias("anchor"))


def _slot(g: np.ndarray, probe: int) -> np.ndarray:
    return (mix(g + np.uint64(probe) * _A) % np.uint64(ANCHOR_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        slots = np.stack([_slot(g, i) for i in range(PROBES)], axis=1).astype(np.int32)
        ends = pa.array(np.arange(len(g) + 1) * PROBES, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("secret"), batch.column("anchor"), pa.ListArray.from_arrays(ends, pa.array(slots.ravel()))], names=["secret", "anchor", "slots"])


def _maybe(bits: np.ndarray):
    """Chunks with eight bytes in a row that may be anchors."""

    def spans(codes: list) -> Iterator[tuple[int, list[bytes]]]:
        first, part, size = 0, [], 0
        for i, code in enumerate(codes):
            part.append(code.encode())
            size += len(part[-1])
            if size >= SPAN:
                yield first, part
                first, part, size = i + 1, [], 0
        yield first, part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, part in spans(batch.column("code").to_pylist()):
                text = b"".join(part)
                if len(text) < 8:
                    continue
                g = grams(text)
                where = np.arange(len(g))
                for i in range(PROBES):
                    slot = _slot(g, i)
                    may = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                    g, where = g[may], where[may]
                # those that reach into the next chunk belong to none, and are told apart by the exact search
                at.append(first + np.searchsorted(np.cumsum([len(c) for c in part]), where, side="right"))
                found.append(g)
            hits = np.unique(np.rec.fromarrays([np.concatenate(at), np.concatenate(found)], names="at,g"))
            rows, starts = np.unique(hits["at"], return_index=True)
            take = pa.array(rows)
            runs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(hits)), pa.int32()), pa.array(np.ascontiguousarray(hits["g"]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_no").take(take), batch.column("code").take(take), runs], names=["chunk_no", "code", "runs"])

    return run


def automaton(values):
    """An automaton of the values, or None of none."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    if not len(a):
        return None
    a.make_automaton()
    return a


def occurrences(code: str, a) -> list[tuple[int, int]]:
    """Non-overlapping occurrences, longest first where they begin together."""
    spans = sorted(((e + 1 - n, e + 1) for e, n in a.iter(code)), key=lambda s: (s[0], -s[1])) if a else []
    out, end = [], 0
    for s in spans:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def redact(code: str, spans: list[tuple[int, int]]) -> str:
    """The spans replaced, a private key from its first dash to its last, and nothing else."""
    parts, at = [], 0
    for a, b in spans:
        parts += [code[at:a], REDACTED]
        at = b
    return "".join([*parts, code[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        secrets, clean = [], []
        a = automaton({v for values in batch.column("values").to_pylist() for v in values})
        for code in batch.column("code").to_pylist():
            spans = occurrences(code, a)
            secrets.append(sorted({code[x:y] for x, y in spans}))
            clean.append(redact(code, spans))
        yield pa.RecordBatch.from_arrays([batch.column("chunk_no"), pa.array(secrets, pa.list_(pa.string())), pa.array(clean, pa.string())], names=["chunk_no", "secrets", "code"])


def confirmed(chunks: DataFrame) -> DataFrame:
    """``(secret, anchor, slots)`` of each value that is structured or named as a credential and not widely shared."""
    rows = chunks.where("code is not null and code <> '' and chunk_no is not null")
    rows = rows.select("chunk_no", F.lower(F.regexp_replace(F.coalesce("repo", F.lit("")), "__.*", "")).alias("owner"), "language", "code")
    index = rows.mapInArrow(_extract, "chunk_no long, owner string, secret string").select("secret", "owner").distinct()
    rare = index.groupBy("secret").agg(F.count("*").alias("owners")).where(F.col("owners") < MAX_OWNERS).select("secret")
    return cut(anchored(rare).mapInArrow(_slots, "secret string, anchor long, slots array<int>"))


def scanned(chunks: DataFrame) -> DataFrame:
    """``(chunk_no, secrets, code)`` of each chunk that holds confirmed values; ``code`` is redacted."""
    known = confirmed(chunks)
    bits = np.zeros(ANCHOR_BITS, bool)
    # one row for each slot, so at most ANCHOR_BITS numbers reach the driver
    slots = known.select(F.explode("slots").alias("slot")).groupBy(F.expr(f"slot div {1 << 12}").alias("p")).agg(F.collect_set("slot").alias("s"))
    for r in slots.toLocalIterator():
        bits[r.s] = True
    rows = chunks.where("code is not null and code <> '' and chunk_no is not null").select("chunk_no", "code")
    maybe = cut(rows.mapInArrow(_maybe(np.packbits(bits)), "chunk_no long, code string, runs array<long>"))
    pairs = maybe.select("chunk_no", F.explode("runs").alias("anchor")).distinct().join(known, "anchor").groupBy("chunk_no").agg(F.collect_set("secret").alias("values"))
    return maybe.dropDuplicates(["chunk_no"]).select("chunk_no", "code").join(pairs, "chunk_no").mapInArrow(_scan, "chunk_no long, secrets array<string>, code string").where("size(secrets) > 0")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned(table(spark, d, "chunks")).select("chunk_no", F.explode("secrets").alias("secret"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return scanned(table(spark, d, "chunks")).select("chunk_no", F.size("secrets").alias("n_secrets"), "code")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
