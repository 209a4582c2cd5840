"""Source files to chunk rows: parsers of one file, and the operator that runs them over a table.

Python is parsed with the standard library's syntax tree. Go, Java, JavaScript
and TypeScript are scanned: strings and comments are blanked (offsets kept),
declarations are matched at line starts and bodies by balanced braces. Known
gaps of the scanner: signatures over several lines are cut at the first brace,
components are told by an upper-case name and a tag in the body, and generic
parameters are not split. A file that cannot be parsed gives one error row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadle.functions.chunking import split_at_boundaries, split_by_size
from treadle.functions.imports import imports_of
from treadle.functions.text import BUILTIN_CALLS, language_of

SCHEMA = (
    "repo string, id string, name string, chunk_type string, file string, start_line int, end_line int, language string, code string, signature string, docstring string, parent string, package_name string, receiver_type string, returns string, "
    "calls array<string>, imports array<string>, decorators array<string>, implements array<string>, is_entry_point boolean, entry_point_type string, entry_point_route string, entry_point_method string, error string, "
    "params array<struct<name:string,type:string>>, type_map map<string,string>, imports_map map<string,struct<from_path:string,name:string>>, calls_with_context array<struct<name:string,receiver:string,receiver_type:string,resolved:boolean>>"
)
FIELDS = re.findall(r"(?:^|, )(\w+) ", SCHEMA)

# Fixed values, in the order in which they are tried. Python: the first that a decorator's lower-cased
# dotted name contains counts; those of the second list carry a route.
PYTHON_ENTRY_RULES = (
    (".get", "http", "GET"), (".post", "http", "POST"), (".put", "http", "PUT"), (".delete", "http", "DELETE"), (".patch", "http", "PATCH"), (".head", "http", "HEAD"), (".options", "http", "OPTIONS"),
    (".route", "http", "ANY"), (".add_route", "http", "ANY"), (".api_route", "http", "ANY"), (".task", "task", None), (".shared_task", "task", None), (".command", "cli", None),
    (".consumer", "kafka", None), ("kafkaconsumer", "kafka", None), (".websocket", "websocket", None), ("on_connect", "websocket", None), (".mutation", "graphql", None), (".query", "graphql", None), (".subscription", "graphql", None),
)
PYTHON_ROUTED = (".route", ".get", ".post", ".put", ".delete", ".patch", ".head", ".options", ".api_route", ".add_route", ".websocket")
# Java annotations and TypeScript decorators by lower-cased name.
JAVA_ENTRY_RULES = {
    "getmapping": ("http", "GET"), "postmapping": ("http", "POST"), "putmapping": ("http", "PUT"), "deletemapping": ("http", "DELETE"), "patchmapping": ("http", "PATCH"), "requestmapping": ("http", "ANY"),
    "kafkalistener": ("kafka", None), "kafkahandler": ("kafka", None), "scheduled": ("cron", None), "rabbitlistener": ("event", None), "sqslistener": ("event", None), "grpcmethod": ("grpc", None),
    "querymapping": ("graphql", None), "mutationmapping": ("graphql", None), "schemamap": ("graphql", None),
}
TYPESCRIPT_ENTRY_RULES = {
    "get": ("http", "GET"), "post": ("http", "POST"), "put": ("http", "PUT"), "delete": ("http", "DELETE"), "patch": ("http", "PATCH"), "head": ("http", "HEAD"), "options": ("http", "OPTIONS"), "all": ("http", "ANY"),
    "messagpattern": ("kafka", None), "eventpattern": ("event", None), "grpcmethod": ("grpc", None), "websocketgateway": ("websocket", None), "subscribemessageof": ("event", None), "cronexpression": ("cron", None),
}
# Calls that register a handler. Go: route methods, of which the second list stands for any method; consumers; schedulers.
GO_ROUTE_CALLS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Any", "Handle", "HandleFunc", "Use", "Group", "Static")
GO_ANY_METHOD = ("HANDLE", "HANDLEFUNC", "USE", "GROUP", "STATIC", "ANY")
GO_CONSUMER_CALLS = ("Subscribe", "Consume", "AddHandler", "RegisterHandler", "ConsumePartition")
GO_SCHEDULE_CALLS = ("AddFunc", "Schedule", "Every", "Cron", "NewJob", "Do")
GO_CONSUMER_METHODS = ("ConsumeClaim", "ProcessMessage", "HandleMessage", "Setup", "Cleanup")
GO_SERVER_SUFFIX = "Server"
# JavaScript: methods of what is called like a router, and of event sources.
JS_ROUTE_CALLS = ("get", "post", "put", "delete", "patch", "head", "options", "all", "use", "route", "handle")
JS_ROUTERS = ("app", "router", "server", "api", "route", "routes", "express", "fastify", "koa", "hapi")
JS_EVENT_CALLS = ("on", "subscribe", "addlistener")


class Ids:
    """Ids of one file: the first keeps its base, later ones get a number."""

    def __init__(self, file):
        self.file, self.seen = file, {}

    def of(self, kind, name):
        base = f"{self.file}::{kind}::{name}"
        n = self.seen.get(base, 0)
        self.seen[base] = n + 1
        return f"{base}_{n}" if n else base


_LISTS = ("calls", "imports", "decorators", "implements", "params", "calls_with_context")


def _row(**x):
    return {f: x.get(f) for f in FIELDS} | {k: x.get(k) or [] for k in _LISTS} | {k: x.get(k) or {} for k in ("type_map", "imports_map")} | {"is_entry_point": bool(x.get("is_entry_point"))}


def _imported(content: str, language: str) -> dict:
    paths, names = imports_of(content, language)
    return {"imports": paths, "imports_map": {k: {"from_path": v, "name": k} for k, v in names.items()}}


def _entry_of(kind, route=None, method=None) -> dict:
    return {"is_entry_point": True, "entry_point_type": kind, "entry_point_route": route or None, "entry_point_method": method}


def _calls(node) -> list[str]:
    out = []
    skip = {id(n) for d in getattr(node, "decorator_list", []) for n in ast.walk(d)}
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and id(n) not in skip:
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name and name not in BUILTIN_CALLS and name not in out:
                out.append(name)
    return out


def _dotted(node) -> str:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return f"{_dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _python_entry(decorators: list) -> dict:
    """The first decorator that a rule matches decides."""
    for d in decorators:
        name = _dotted(d).lower()
        rule = next((r for r in PYTHON_ENTRY_RULES if r[0] in name), None)
        if not rule:
            continue
        _, kind, method = rule
        route = None
        if isinstance(d, ast.Call) and (kind == "kafka" or any(p in name for p in PYTHON_ROUTED)):
            first = d.args[0] if d.args else None
            route = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
            listed = next((k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List)), None)
            if listed and kind != "kafka":
                method = ",".join(str(e.value).upper() for e in listed.elts if isinstance(e, ast.Constant)) or method
        return _entry_of(kind, route, method)
    return {}


def _python_types(node) -> dict[str, str]:
    """Names to types: of parameters, annotated names, and what a call is assigned to."""
    out = {}
    for n in ast.walk(node):
        if isinstance(n, ast.arg) and n.annotation is not None:
            out[n.arg] = ast.unparse(n.annotation)
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            out[n.target.id] = ast.unparse(n.annotation)
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
            made = _dotted(n.value).rsplit(".", 1)[-1]
            out |= {t.id: made for t in n.targets if isinstance(t, ast.Name) and made}
    return {k: v for k, v in out.items() if v != "Any"}


def _python_contexts(node, types: dict[str, str]) -> list[dict]:
    """Each call once by receiver and name; of a chain the last name before the call is the receiver."""
    found = {}
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id
            of = _dotted(n.func.value).rsplit(".", 1)[-1] or None if isinstance(n.func, ast.Attribute) else None
            if name not in BUILTIN_CALLS:
                found.setdefault((of, name), {"name": name, "receiver": of, "receiver_type": types.get(of), "resolved": of in types})
    return list(found.values())


def parse_python(content: str, file: str) -> list[dict]:
    tree, lines, ids, out = ast.parse(content), content.split("\n"), Ids(file), []
    shared = {"file": file, "language": "python", **_imported(content, "python")}

    def add(node, kind, parent=None, **more):
        cid = ids.of(kind, node.name)
        types = _python_types(node)
        out.append(_row(
            id=cid, name=node.name, chunk_type=kind, start_line=node.lineno, end_line=node.end_lineno, code="\n".join(lines[node.lineno - 1 : node.end_lineno]), docstring=ast.get_docstring(node), parent=parent,
            calls=_calls(node), decorators=[ast.unparse(d) for d in node.decorator_list], type_map=types, calls_with_context=_python_contexts(node, types), **shared, **more,
        ))
        return cid

    def visit(body, parent=None):
        for n in body:
            if isinstance(n, ast.ClassDef):
                bases = [b for b in map(ast.unparse, n.bases) if b != "object"]
                visit(n.body, add(n, "class", parent, implements=bases, signature=f"class {n.name}" + (f"({', '.join(bases)})" if bases else "")))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                entry = _python_entry(n.decorator_list)
                if not entry and not parent and n.name == "main":
                    entry = _entry_of("main")
                returns = ast.unparse(n.returns) if n.returns else None
                args = [*n.args.posonlyargs, *n.args.args, n.args.vararg, *n.args.kwonlyargs, n.args.kwarg]
                params = [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else "any"} for a in args if a and a.arg not in ("self", "cls")]
                add(n, "method" if parent else "function", parent, signature=f"{n.name}({ast.unparse(n.args)})" + (f" -> {returns}" if returns else ""), params=params, returns=returns, **entry)

    visit(tree.body)
    whole = dict(start_line=1, end_line=len(lines), code=content, calls=_calls(tree), calls_with_context=_python_contexts(tree, _python_types(tree)), **shared)
    if any(isinstance(n, ast.If) and "__name__" in ast.unparse(n.test) and "__main__" in ast.unparse(n.test) for n in tree.body):
        out.append(_row(id=ids.of("function", "__main__"), name="__main__", chunk_type="function", **whole, **_entry_of("main")))
    return out or [_row(id=ids.of("module", file), name=file, chunk_type="module", **whole)]


_BLANKS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?")
_DECLARATIONS = {
    "go": [("method", r"func[ \t]*\([ \t]*\w*[ \t]*\*?([A-Z_a-z]\w*)[^)]*\)[ \t]*(?P<name>\w+)[ \t]*\("), ("function", r"func[ \t]+(?P<name>\w+)"), ("struct", r"type[ \t]+(?P<name>\w+)[ \t]+struct\b"), ("interface", r"type[ \t]+(?P<name>\w+)[ \t]+interface\b"), ("type", r"type[ \t]+(?P<name>\w+)[ \t]+\w")],
    "java": [("class", r"(?:[\w@]+[ \t]+)*(?:class|record)[ \t]+(?P<name>\w+)"), ("interface", r"(?:\w+[ \t]+)*interface[ \t]+(?P<name>\w+)"), ("enum", r"(?:\w+[ \t]+)*enum[ \t]+(?P<name>\w+)"), ("method", r"(?:(?:public|protected|private|static|final|abstract|synchronized|default)[ \t]+)*(?:<[^>\n]+>[ \t]*)?(?:[\w.$<>\[\], ?]+[ \t]+)?(?P<name>[A-Za-z_$]\w*)[ \t]*\([^;{}]*\)[^;{}]*(?=\{)")],
    "javascript": [("class", r"(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<name>\w+)"), ("interface", r"(?:export[ \t]+)?interface[ \t]+(?P<name>\w+)"), ("type", r"(?:export[ \t]+)?type[ \t]+(?P<name>\w+)[^=\n]*="), ("function", r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^>\n]*>)?\("), ("function", r"(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]+)?(?:function\b|\([^;{}]*?\)[^;{}=]*=>|[\w$]+[ \t]*=>)"), ("method", r"(?:(?:public|private|protected|static|async|get|set)[ \t]+)*(?P<name>[\w$]+)[ \t]*\([^;{}]*\)[^;{}=]*(?=\{)")],
}
_DECLARATIONS = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _DECLARATIONS.items()}
_DECLARATIONS["typescript"] = _DECLARATIONS["javascript"]
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "function", "select", "go", "defer", "func", "case", "super", "this"}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)[ \t]*\(")
_CONTEXT = re.compile(r"(?:([A-Za-z_$][\w$]*|[)\]])[ \t]*\??\.[ \t\n]*)?(?<![\w$])([A-Za-z_$][\w$]*)[ \t]*\(")
_REGISTER = re.compile(r"(?:([\w$]+)[ \t]*\.[ \t]*)?([A-Za-z_$][\w$]*)\(([^(){};\n]*(?:\{[^{}()\n]*\})?[^(){};\n]*)\)")
_QUOTED = re.compile(r"[\"'`]([^\"'`\n]*)[\"'`]")
_NAME_ONLY = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_TYPED = {
    "go": [re.compile(r"\bvar[ \t]+(\w+)[ \t]+([\w.*\[\]]+)"), re.compile(r"(\w+)[ \t]*:?=[ \t]*&?((?:\[\d*\]|\*)*[A-Za-z_][\w.]*)[ \t]*(\{|\()")],
    "java": [re.compile(r"(?<![\w.])([A-Z][\w.]*(?:<[\w<>?, .]*>)?(?:\[\])*)[ \t]+([a-z_]\w*)[ \t]*(?=[=;,)])"), re.compile(r"\bvar[ \t]+(\w+)[ \t]*=[ \t]*new[ \t]+([\w.]+)")],
    "javascript": [re.compile(r"([\w$]+)[ \t]*=[ \t]*new[ \t]+([\w$.]+)"), re.compile(r"(?<![\w$?.])([\w$]+)\??[ \t]*:[ \t]*([A-Z][\w$.]*(?:<[\w$<>, .]*>)?(?:\[\])*)")],
}
_TYPED["typescript"] = _TYPED["javascript"]


def _types(code: str, language: str) -> dict[str, str]:
    """Names to types as they stand; of Go constructors the type they are named after."""
    out = {}
    for i, pattern in enumerate(_TYPED[language]):
        for m in pattern.finditer(code):
            name, kind = m.group(1), m.group(2)
            if language == "java" and i == 0:
                name, kind = kind, name
            if language == "go" and i == 1 and m.group(3) == "(":
                owner, _, made = kind.rpartition(".")
                made = made[3:] if made.startswith("New") and len(made) > 3 else made
                kind = f"{owner}.{made}" if owner else made
            if kind not in _KEYWORDS and name not in _KEYWORDS:
                out[name] = kind
    return out


def _contexts(body: str, types: dict[str, str], own: str) -> list[dict]:
    found = {}
    for of, name in _CONTEXT.findall(body):
        of = of or None
        if name not in _KEYWORDS and name not in BUILTIN_CALLS and len(name) > 1 and (of or name != own):
            found.setdefault((of, name), {"name": name, "receiver": of, "receiver_type": types.get(of), "resolved": of in types})
    return list(found.values())


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def _params(text: str, language: str) -> list[dict]:
    out = []
    for p in _split(text):
        if language == "go":
            name, _, kind = p.partition(" ")
        elif language == "java":
            kind, _, name = re.sub(r"@\w+(?:\([^)]*\))?[ \t]*|\bfinal[ \t]+", "", p).rpartition(" ")
        else:
            name, _, kind = re.sub(r"[ \t]*=[^>].*$", "", p).partition(":")
            name = re.sub(r"^(?:(?:public|private|protected|readonly)[ \t]+)+|\?$", "", name.strip())
        out.append({"name": name.strip(), "type": kind.strip() or None})
    if language == "go":  # names of one type: a, b int
        for a, b in zip(reversed(out[:-1]), reversed(out[1:])):
            a["type"] = a["type"] or b["type"]
    return [{"name": p["name"], "type": p["type"] or "any"} for p in out if p["name"]]


def _signed(signature: str, name: str, language: str) -> tuple[list[dict], str | None]:
    """Parameters and the type returned, of a signature on which ``name`` stands before its parameters."""
    at = re.search(rf"(?<![\w$]){re.escape(name)}[^(=]*(?:=[ \t]*(?:async[ \t]+)?(?:function[ \t]*)?)?\(", signature)
    if not at:
        return [], None
    depth, end = 1, at.end()
    while end < len(signature) and depth:
        depth += (signature[end] == "(") - (signature[end] == ")")
        end += 1
    params = _params(signature[at.end() : end - 1], language)
    if language == "java":
        before = re.sub(r"@\w+(?:\([^)]*\))?|\b(?:public|protected|private|static|final|abstract|synchronized|default)\b|^\s*<[^>]*>", "", signature[: at.start()]).strip()
        return params, before or None
    after = re.sub(r"=>.*$", "", signature[end:], flags=re.S).strip()
    return params, (after if language == "go" else after.removeprefix(":").strip()) or None


def _registrations(content: str, language: str) -> dict[str, dict]:
    """Handlers that a call registers, with their entry; routes go before consumers, these before schedules."""
    ranked: dict[str, tuple[int, dict]] = {}
    for of, call, args in _REGISTER.findall(content):
        handler = next((a for a in reversed(_split(args)) if _NAME_ONLY.fullmatch(a)), None)
        said = _QUOTED.search(args)
        if not handler or handler in ("nil", "null", "ctx"):
            continue
        handler, said = handler.rsplit(".", 1)[-1], said.group(1) if said else ""
        found = None
        if language == "go":
            if of and call in GO_ROUTE_CALLS:
                found = 0, _entry_of("http", said, "ANY" if call.upper() in GO_ANY_METHOD else call.upper())
            elif call in GO_CONSUMER_CALLS:
                found = 1, _entry_of("kafka", said)
            elif call in GO_SCHEDULE_CALLS:
                found = 2, _entry_of("cron", said)
        elif of and call.lower() in JS_ROUTE_CALLS and of.lower() in JS_ROUTERS:
            found = 0, _entry_of("http", said, call.upper())
        elif of and call.lower() in JS_EVENT_CALLS:
            found = 1, _entry_of("event", said)
        if found and found[0] <= ranked.get(handler, (9,))[0]:
            ranked[handler] = found
    return {k: v for k, (_, v) in ranked.items()}


def _go_named(name: str, kind: str, package: str | None, receiver: str | None) -> dict:
    if kind == "function" and (name == "init" or name == "main" and package == "main"):
        return _entry_of(name)
    if kind == "method" and name in GO_CONSUMER_METHODS:
        return _entry_of("kafka")
    if kind == "method" and receiver and receiver.endswith(GO_SERVER_SUFFIX):
        return _entry_of("grpc", f"{receiver}.{name}")
    return {}


_NOTE = re.compile(r"@([\w.]+)[ \t]*(?:\((.*)\))?[ \t]*$")


def _noted(notes: list[str], language: str, base: str = "") -> dict:
    """The entry of the first annotation that a rule names; a class's path goes before a method's."""
    for note in notes:
        m = _NOTE.match(note)
        name = m.group(1).rsplit(".", 1)[-1].lower() if m else ""
        rule = (JAVA_ENTRY_RULES if language == "java" else TYPESCRIPT_ENTRY_RULES).get(name)
        if not rule:
            continue
        kind, method = rule
        attrs = {k: (v if v is not None else w) for k, v, w in re.findall(r"(\w+)[ \t]*=[ \t]*(?:\{?[ \t]*\"([^\"]*)\"|([\w.]+))", m.group(2) or "") for v in [v or None]}
        first = re.match(r"[ \t]*\{?[ \t]*[\"'`]([^\"'`]*)", m.group(2) or "")
        route = first.group(1) if first else attrs.get("value") or attrs.get("path") or ""
        if language == "java":
            method = method and attrs.get("method", method).rsplit(".", 1)[-1].upper()
            if kind == "kafka":
                return _entry_of(kind, attrs.get("topics", route), method)
            route = f"{base.rstrip('/')}/{route.lstrip('/')}" if base else route
        return _entry_of(kind, route, method)
    return {}


def _base_of(notes: list[str]) -> str:
    for note in notes:
        if re.match(r"@(?:RequestMapping|Controller)\b", note):
            said = re.search(r"[\"'`]([^\"'`]*)", note)
            return said.group(1) if said else ""
    return ""


def scan(content: str, file: str, language: str) -> list[dict]:
    blank = _BLANKS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content)
    lines, ids = content.split("\n"), Ids(file)
    said = re.search(r"(?m)^[ \t]*package[ \t]+([\w.]+)", blank) if language in ("go", "java") else None
    package = said.group(1) if said else None
    shared = {"file": file, "language": language, "package_name": package, **_imported(content, language)}
    handlers = _registrations(content, language) if language != "java" else {}
    fields = _types(blank, language) if language == "java" else {}
    bases: dict[str, str] = {}
    out, open_classes, at = [], [], 0
    for i, line in enumerate(lines):
        start = at
        at += len(line) + 1
        text = start + len(line) - len(line.lstrip())
        open_classes = [c for c in open_classes if c[0] > text]
        for kind, pattern in _DECLARATIONS[language]:
            m = pattern.match(blank, text)
            if not m or m.group("name") in _KEYWORDS or kind == "method" and language != "go" and not open_classes:
                continue
            brace = blank.find("{", m.end() - 1 if kind == "method" and language != "go" else m.end())
            newline = blank.find("\n\n", m.end())
            end = len(lines[i]) + start
            if brace >= 0 and (newline < 0 or brace < newline):
                depth, j = 0, brace
                while j < len(blank):
                    depth += (blank[j] == "{") - (blank[j] == "}")
                    if depth == 0:
                        break
                    j += 1
                end = j + 1
            name = m.group("name")
            if any(c[0] >= end and c[2] for c in open_classes) and kind == "function":
                break
            body = blank[m.end() : end]
            parent = open_classes[-1][1] if open_classes and kind != "function" else None
            if kind == "method" and language == "go":
                parent = f"{file}::struct::{m.group(1)}"
            if kind == "function" and language in ("javascript", "typescript") and name[0].isupper() and re.search(r"<[A-Za-z/]", content[m.end() : end]):
                kind = "component"
            cid = ids.of(kind, name)
            j, notes, comment = i - 1, [], []
            while j >= 0 and (lines[j].strip().startswith(("@", "//", "*", "/*")) or lines[j].strip().endswith("*/")):
                (notes if lines[j].strip().startswith("@") else comment).insert(0, lines[j].strip())
                j -= 1
            doc = "\n".join(re.sub(r"^(?:/\*\*?|\*/|\*|//)[ \t]?|\*/$", "", c).rstrip() for c in comment).strip() or None
            if kind in ("class", "interface"):
                bases[cid] = _base_of(notes)
            entry = {}
            if kind in ("function", "method", "component"):
                entry = (_noted(notes, language, bases.get(parent, "") if language == "java" else "") if language in ("java", "typescript") else {}) or handlers.get(name, {})
            receiver = m.group(1) if kind == "method" and language == "go" else None
            if not entry and language == "go":
                entry = _go_named(name, kind, package, receiver)
            if not entry and language == "java" and name == "main" and kind == "method":
                entry = _entry_of("main")
            heritage = re.search(r"\b(?:implements|extends)\b([^{]*)", blank[m.end() : max(brace, m.end())])
            calls = [c for c in dict.fromkeys(_CALL.findall(body)) if c not in _KEYWORDS and c not in BUILTIN_CALLS and c != name]
            last = content.count("\n", 0, end) + 1
            signature = content[text : brace if 0 <= brace < end else end].strip()
            params, returns = _signed(signature, name, language) if kind in ("function", "method", "component") else ([], None)
            types = fields | {p["name"]: p["type"] for p in params if p["type"] != "any"} | _types(blank[text:end], language)
            if receiver:
                types |= {v: receiver for v in re.findall(r"func[ \t]*\([ \t]*(\w+)[ \t]", signature)}
            out.append(_row(
                id=cid, name=name, chunk_type=kind, start_line=i + 1, end_line=last, code="\n".join(lines[i:last]), signature=signature, docstring=doc, parent=parent, calls=calls, decorators=notes, receiver_type=receiver,
                params=params, returns=returns, type_map=types, calls_with_context=_contexts(body, types, name),
                implements=[x.strip() for x in re.split(r",|\bimplements\b|\bextends\b", heritage.group(1)) if x.strip()] if heritage else [], **shared, **entry,
            ))
            if kind in ("class", "interface", "enum", "method", "function", "component"):
                open_classes.append((end, cid, kind in ("function", "method", "component")))
            break
    # what is declared inside a function or method is no chunk of its own
    return out or [_row(id=ids.of("module", file), name=file, chunk_type="module", start_line=1, end_line=len(lines), code=content, **shared)]


def parse_generic(content: str, file: str, language: str) -> list[dict]:
    """Blocks that begin with a definition, or, where there are none, blocks by size."""
    ids = Ids(file)
    blocks = [(name, a, b, body) for name, a, b, body in split_at_boundaries(content)] or [(f"block_L{a}", a, b, body) for a, b, body in split_by_size(content)]
    return [_row(id=ids.of("block", name.removeprefix("block_")), name=name, chunk_type="block", file=file, start_line=a, end_line=b, language=language, code=body) for name, a, b, body in blocks]


def parse_file(content: str, file: str, language: str | None) -> list[dict]:
    if language == "python":
        return parse_python(content, file)
    if language in _DECLARATIONS:
        return scan(content, file, language)
    return parse_generic(content, file, language or "unknown")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.list_(pa.string())
    context = pa.struct([("name", pa.string()), ("receiver", pa.string()), ("receiver_type", pa.string()), ("resolved", pa.bool_())])
    kinds = {
        "start_line": pa.int32(), "end_line": pa.int32(), "is_entry_point": pa.bool_(), "params": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])), "type_map": pa.map_(pa.string(), pa.string()),
        "imports_map": pa.map_(pa.string(), pa.struct([("from_path", pa.string()), ("name", pa.string())])), "calls_with_context": pa.list_(context),
    } | dict.fromkeys(("calls", "imports", "decorators", "implements"), text)
    maps = ("type_map", "imports_map")
    for batch in batches:
        rows = []
        for repo, path, content, language in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content", "language"))):
            try:
                rows += [r | {"repo": repo} for r in parse_file(content, path, language)]
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append(_row(repo=repo, file=path, language=language, error=f"{type(e).__name__}: {e}"[:200]))
        yield pa.RecordBatch.from_arrays([pa.array([list(r[f].items()) if f in maps else r[f] for r in rows], kinds.get(f, pa.string())) for f in FIELDS], names=FIELDS)


def parse_sources(files: DataFrame) -> DataFrame:
    """Chunk rows of ``files(repo, path, content)``; null contents give none, bad files an error row."""
    rows = files.where("content is not null and path is not null").select("repo", "path", "content", language_of(F.col("path")).alias("language"))
    return rows.mapInArrow(_run, SCHEMA)
