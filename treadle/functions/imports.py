"""Imports of raw source text: the paths, and the local name of each path.

One statement pattern per language finds where imports stand; what they name is
then split by hand. Known gap: strings and comments are not told from code.
"""

from __future__ import annotations

import re

_PY_FROM = re.compile(r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)")
_PY_PLAIN = re.compile(r"(?m)^[ \t]*import[ \t]+([^\n#;]+)")
_JS_FROM = re.compile(r"\bimport\s+(?:type\s+)?([^;\"'`]*?)\s+from\s+[\"']([^\"'\n]+)[\"']")
_JS_REQUIRE = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']")
_JAVA = re.compile(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+\*?)")
_GO = re.compile(r"(?m)^[ \t]*import[ \t]*(?:\(([^)]*)\)|([^\n(]+))")
_GO_SPEC = re.compile(r"^\s*(?:(\S+)\s+)?\"([^\"]+)\"")


def aliased(names: str) -> list[tuple[str, str]]:
    """``(name, local name)`` of each entry of a comma list, with or without ``as``."""
    out = []
    for part in names.strip("(){} \t\n").split(","):
        words = part.split()
        if len(words) == 3 and words[1] == "as":
            out.append((words[0], words[2]))
        elif len(words) == 1:
            out.append((words[0], words[0]))
    return out


def _python(content: str):
    for m in _PY_FROM.finditer(content):
        for name, local in aliased(m.group(2)):
            yield (f"{m.group(1)}.*", None) if name == "*" else (f"{m.group(1)}.{name}", local)
    for m in _PY_PLAIN.finditer(content):
        yield from aliased(m.group(1))


def _javascript(content: str):
    for m in _JS_FROM.finditer(content):
        clause, module = m.groups()
        braces = re.search(r"\{([^}]*)\}", clause)
        for name, local in aliased(braces.group(1)) if braces else ():
            yield f"{module}.{name}", local
        rest = re.sub(r"\{[^}]*\}", "", clause)
        for part in filter(None, map(str.strip, rest.split(","))):
            yield module, part.split()[-1]  # a default name, or what follows "* as"
    for m in _JS_REQUIRE.finditer(content):
        yield m.group(2), m.group(1)


def _java(content: str):
    for m in _JAVA.finditer(content):
        last = m.group(1).rsplit(".", 1)[-1]
        yield m.group(1), None if last == "*" else last


def _go(content: str):
    for m in _GO.finditer(content):
        for line in (m.group(1) if m.group(1) is not None else m.group(2)).split("\n"):
            spec = _GO_SPEC.match(line)
            if spec and not line.lstrip().startswith("//"):
                name, path = spec.groups()
                yield path, path.rsplit("/", 1)[-1] if name in (None, ".") else None if name == "_" else name


_BY_LANGUAGE = {"python": _python, "java": _java, "go": _go, "javascript": _javascript, "typescript": _javascript}


def imports_of(content: str, language: str) -> tuple[list[str], dict[str, str]]:
    """All paths in the order they stand, and local name to path; the last of one name counts."""
    found = list(_BY_LANGUAGE[language](content))
    return list(dict.fromkeys(p for p, _ in found)), {name: path for path, name in found if name}
