"""Functions paired with their documentation, by island grammars.

A text is mostly water. The islands are documentation, annotations, signatures
and balanced bodies: a scanner skips strings, comments and everything else until
a signature at the top level begins, takes the comment that ends right above it
(annotations may lie between) or the string that opens its body, skips the
balanced body and goes on. One grammar per language; others have no functions.

Documentation is trivial if, without markers and tags, it has fewer than five
words, only words of the function's own name with filler, a placeholder, a
separator, a tool directive or code put out of use.

Defined results: a null or empty ``docstring`` is looked up in ``code``; a null
name gives no pair; null code documents nothing; rows delivered twice count
once; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.session import absent, table

LEAST_WORDS = 5

_HASH = ("python", "ruby", "shell", "yaml", "toml")
_PY_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_]\w*)")
_STRING_OPEN = re.compile(r"[rRuUbB]{0,2}(\"\"\"|'''|\"|')")
#: Signatures that begin a line, by language; the group is the name.
SIGNATURES = {
    "python": re.compile(r"(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)[ \t]*\("),
    "go": re.compile(r"func[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Za-z_]\w*)[ \t]*(?:\[[^\]\n]*\])?\("),
    "java": re.compile(r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>\n]+>[ \t]*)?[\w.$]+(?:<[^;{}()\n]*>)?(?:\[\])*[ \t]+([A-Za-z_$][\w$]*)[ \t]*\((?=[^;]*?\)[^;{}]*\{)"),
    "javascript": re.compile(
        r"(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*([A-Za-z_$][\w$]*)[ \t]*(?:<[^>\n]*>)?\("
        r"|(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?(?:function\b[ \t]*\*?[ \t]*\w*[ \t]*\(|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)[ \t]*(?::[^=\n{]+)?=>))"
    ),
}
SIGNATURES["typescript"] = SIGNATURES["javascript"]
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "synchronized"}
_ANNOTATION = re.compile(r"[ \t]*@[A-Za-z_][\w.]*")
_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?")


def _is_comment(line: str, language: str) -> bool:
    s = line.lstrip()
    return s.startswith("#") if language in _HASH else s.startswith("//")


def comment_above(lines: list[str], at: int, language: str) -> str:
    """The comment that ends right above line ``at``; annotations may lie between."""
    i = at - 1
    while i >= 0 and _ANNOTATION.match(lines[i]) and not _is_comment(lines[i], language):
        i -= 1
    if i < 0:
        return ""
    if language not in _HASH and lines[i].rstrip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(lines[max(j, 0) : i + 1]) if j >= 0 and lines[j].lstrip().startswith("/*") else ""
    j = i
    while j >= 0 and _is_comment(lines[j], language):
        j -= 1
    return "\n".join(lines[j + 1 : i + 1])


def opening_string(text: str, at: int) -> str | None:
    """The string that opens the body of the ``def`` or ``class`` at ``at``, up to the end of the text if it is cut."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?").match(text, i)
            i = m.end()
            continue
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return None
        elif c == ":" and depth == 0:
            break
        i += 1
    i += 1
    while True:  # white space and comments before the first statement
        m = re.compile(r"\s*(?:#[^\n]*)?").match(text, i)
        if m.end() == i or i >= n:
            break
        i = m.end()
    m = _STRING_OPEN.match(text, i)
    if not m:
        return None
    q = m.group(1)
    if len(q) == 1:
        end = re.compile(rf"(?:[^{q}\\\n]|\\.)*").match(text, m.end()).end()
    else:
        end = text.find(q, m.end())
    return text[m.end() : end if end >= 0 else n]


def documentation_of(code: str, language: str) -> list[str]:
    """What may document the function a text holds: its leading comment and its opening string."""
    lines = code.split("\n")
    at = 0
    out = []
    while at < len(lines):  # the first line that is neither blank, comment nor annotation
        s = lines[at].lstrip()
        if not s or _is_comment(lines[at], language) or _ANNOTATION.match(lines[at]):
            at += 1
        elif language not in _HASH and s.startswith("/*"):
            while at < len(lines) and "*/" not in lines[at]:
                at += 1
            at += 1
        else:
            break
    above = comment_above(lines, at, language)
    if above:
        out.append(above)
    if language == "python" and at < len(lines):
        start = sum(len(x) + 1 for x in lines[:at])
        if _PY_DEF.match(code, start):
            s = opening_string(code, start)
            if s is not None:
                out.append(s)
    return out


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def functions(code: str, language: str) -> list[tuple[str, list[str], int, int]]:
    """(name, documentation, start, end) of each function at the top level of a text."""
    signature = SIGNATURES.get(language)
    if signature is None:
        return []
    lines = code.split("\n")
    starts = [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    out = []
    if language == "python":
        masked = re.sub(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)", _blank, code).split("\n")
        heads = [i for i, x in enumerate(masked) if x and not x[0].isspace()]
        for i in heads:
            m = signature.match(masked[i])
            if m:
                docs = [c for c in (comment_above(lines, i, language), opening_string(code, starts[i])) if c]
                end = next((starts[j] for j in heads if j > i), len(code))
                out.append((m.group(1), docs, starts[i], end))
        return out
    masked = _MASK.sub(_blank, code)
    depth = 0
    skip_to = -1
    for i, s in enumerate(starts):
        line = masked[s : s + len(lines[i])]
        if depth == 0 and s >= skip_to and line and not line[0].isspace():
            m = signature.match(masked, s)
            name = m and next((g for g in m.groups() if g), None)
            if name and name not in _NO_NAME and line.split("(")[0].split()[0] not in _NO_NAME:
                comment = comment_above(lines, i, language)
                out.append((name, [comment] if comment else [], s, len(code)))
        depth = max(0, depth + line.count("{") + line.count("(") - line.count("}") - line.count(")"))
        if depth == 0 and out and out[-1][3] == len(code) and "}" in line:
            out[-1] = (*out[-1][:3], s + len(lines[i]))
    return out


_MARKERS = re.compile(r"(?m)^[ \t]*(?:/\*\*?|\*/|\*|//[/!]?|#+!?:?|--|;+|\"\"\"|'''|[-+•])?[ \t]?")
_CLOSERS = re.compile(r"\*/|/\*+|\"\"\"|'''|</?[A-Za-z][^<>\n]{0,60}>")
_TAG = re.compile(r"(?m)^[ \t]*(?:[@:\\](?:param|arg|argument|type|parameter|keyword|property|prop|throws|exception|raises?|raise|template|typeparam)\b[ \t]*(?:\{[^}\n]*\})?[ \t]*[\w.$*\[\]]*[ \t]*:?|[@:\\][A-Za-z]+\b:?[ \t]*(?:\{[^}\n]*\})?|(?:args|arguments|parameters|params|returns?|raises|yields|notes?|examples?|see also|todo)[ \t]*:[ \t]*$)", re.I)
_INLINE_TAG = re.compile(r"\{@\w+\s+([^}]*)\}")
_DIRECTIVE = re.compile(
    r"(?im)^[ \t]*(?:noqa\b.*|type:[ \t]*ignore.*|pylint:.*|flake8:.*|mypy:.*|pyright:.*|isort:.*|fmt:[ \t]*\w+.*|yapf:.*|pragma\b.*|nosec\b.*|coverage:.*|-\*-.*|@?formatter:\w+.*|clang-format\b.*|eslint-.*|eslint\b.*|jshint\b.*|jslint\b.*|prettier-ignore.*|tslint:.*"
    r"|@ts-[a-z-]+.*|istanbul\b.*|c8\b.*|v8\b.*|go:\w+.*|nolint\b.*|lint:.*|\+build\b.*|#?region\b.*|#?endregion\b.*|checkstyle\b.*|nopmd\b.*|noinspection\b.*|suppress(?:warnings|lint)?\b.*|sonar\w*\b.*|language=\w+.*|vim:.*|spell-?check.*|cspell:.*|codecov\b.*|webpack\w*:.*|@vite-ignore.*|deno-lint\b.*|biome-ignore\b.*|ruff:.*|black:.*|skipcq\b.*|nosonar\b.*|keep-sorted.*)$"
)
_CODE = re.compile(
    r"^[ \t]*(?:(?:(?:var|let|const|final|auto|val|self\.|this\.)[ \t]*)?[\w.$\[\]\"'()]+(?:[ \t]*,[ \t]*[\w.$\[\]]+)*[ \t]*(?:=|:=|\+=|-=|\*=|/=|\|=|&=|==|!=)[ \t]*\S.*|.*[;{}][ \t]*|[\w.$]+\([^)]*\)[ \t]*;?|(?:if|for|while|elif|with|def|class|func|function|switch|try|except|catch)\b.*[:{(][ \t]*|(?:return|raise|throw|import|from|package|break|continue|defer|go|await|yield)\b[ \t]*[\w.$]*(?:[.(=].*)?;?[ \t]*|[\w<>\[\].$]+[ \t]+[\w$]+[ \t]*=[ \t]*\S.*)$"
)
_PLACEHOLDER = re.compile(
    r"(?is)^\W*(?:todo|fixme|xxx|tbd|tbc|wip|n/?a|none|null|nothing|placeholder|description|docstring|documentation|undocumented|no (?:description|documentation|docs?)|missing (?:description|docs?|documentation)|insert \w+ here|lorem ipsum|your (?:description|text) here|(?:add|write|fill in|put|provide) (?:a |the |some )?(?:description|documentation|docs?|docstring|comment)|auto-?generated (?:method|constructor|function) stub|\(non-javadoc\)|see (?:above|below))\b"
)
_FILLER = {
    *"a an the this that these those it its is are be was to of for in on at by with from and or as into function functions method methods helper func procedure routine class object objects value values given specified some one instance helper".split(),
    *"returns return gets get sets set does do performs perform handles handle implements implementation main simple simply just here description documentation describe describes new".split(),
    *"die der das den dem des ein eine einer und oder funktion methode le la les un une des du de et ou fonction méthode el los las una y o función método".split(),
}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def plain_text(doc: str) -> str:
    """Documentation without markers, tags, directives and lines of code."""
    s = _CLOSERS.sub(" ", doc)
    s = _MARKERS.sub("", s)
    s = _INLINE_TAG.sub(r" \1 ", s)
    s = _DIRECTIVE.sub(" ", s)
    s = _TAG.sub(" ", s)
    return "\n".join(x for x in s.split("\n") if not _CODE.match(x))


def _stem(w: str) -> str:
    for end in ("ing", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def real(doc: str | None, name: str) -> bool:
    """Whether a text says something about the function."""
    if not doc or not doc.strip():
        return False
    s = plain_text(doc)
    if _PLACEHOLDER.match(s):
        return False
    words = [w.lower() for w in _WORD.findall(s)]
    if len(words) + len(_CJK.findall(s)) // 2 < LEAST_WORDS:
        return False
    own = {_stem(w.lower()) for w in _NAME_PART.findall(name)} | {w.lower() for w in _NAME_PART.findall(name)} | {name.lower().replace("_", "")}
    return any(w not in _FILLER and w not in own and _stem(w) not in own for w in words)


def _pairs(full: bool):
    names = ["chunk_no", "repo", "file", "unsplit", "fn_name", *(["documentation", "code"] if full else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (kind, language, name, doc, code) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk_type", "language", "name", "docstring", "code")))):
                if kind == "module":
                    found = [(n, [d for d in docs if real(d, n)], code[a:b]) for n, docs, a, b in functions(code or "", language)]
                else:
                    docs = [doc] if doc else documentation_of(code or "", language)
                    found = [(name, [d for d in docs if real(d, name)], code)]
                for n, docs, body in found:
                    if docs:
                        at.append(i)
                        rows.append((kind == "module", n, plain_text(docs[0]).strip() if full else None, body))
            take = pa.array(at, pa.int64())
            cols = [batch.column(c).take(take) for c in ("chunk_no", "repo", "file")]
            cols += [pa.array([r[0] for r in rows], pa.bool_())] + [pa.array([r[j] for r in rows], pa.string()) for j in ((1, 2, 3) if full else (1,))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def documented(chunks: DataFrame, full: bool = False) -> DataFrame:
    """``(chunk_no, fn_name)`` of each function with real documentation; ``full`` adds both texts."""
    doc = absent(F.col("docstring"))
    # the code of documented chunks is read only for the pairs themselves
    code = F.col("code") if full else F.when(doc.isNull() | (F.col("chunk_type") == "module"), F.col("code"))
    rows = chunks.where("chunk_no is not null and chunk_type in ('function', 'method', 'module') and (chunk_type = 'module' or name is not null)").select(
        "chunk_no", "repo", "file", "chunk_type", "language", "name", doc.alias("docstring"), code.alias("code")
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"chunk_no {types['chunk_no']}, repo {types['repo']}, file {types['file']}, unsplit boolean, fn_name string" + ", documentation string, code string" * full
    found = rows.mapInArrow(_pairs(full), schema)
    # a module chunk is an unsplit file only if its file has no other chunk
    single = chunks.groupBy("repo", "file").agg(F.min("chunk_no").alias("a"), F.max("chunk_no").alias("b")).where("a = b").select("repo", "file")
    out = ["chunk_no", "fn_name", *(["documentation", "code"] if full else [])]
    split = found.where("not unsplit").select(*out)
    return split.unionByName(found.where("unsplit").join(single, ["repo", "file"], "left_semi").select(*out)).dropDuplicates(["chunk_no", "fn_name"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return documented(table(spark, d, "chunks"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented(table(spark, d, "chunks"), full=True)


QUERIES = {"p7_found": p7_found, "p7_pairs": p7_pairs}
SQL: dict[str, str] = {}
