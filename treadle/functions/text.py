"""Text, name and path rules of chunks, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as the analysed data has them.
TEST_PATHS = ("test_", "_test.", "/tests/", "/test/", ".test.", ".spec.", "spec/", "testing/", "__tests__")
TEST_DECORATORS = ("Test", "pytest.mark", "unittest")
GO_EXTERNAL_HOSTS = ("github.com/", "golang.org/", "google.golang.org/", "gopkg.in/", "go.uber.org/", "k8s.io/", "cloud.google.com/", "gorm.io/")
JAVA_EXTERNAL = ("java.", "javax.", "org.springframework", "org.apache", "org.slf4j", "com.google", "com.fasterxml", "org.junit", "org.mockito", "lombok", "org.hibernate", "jakarta.", "io.swagger", "reactor.")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "bash",
    ".sql": "sql", ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".xml": "xml", ".ini": "ini",
    ".env": "env", ".properties": "properties",
}
IGNORED_DIRS = ("node_modules", ".git", "__pycache__", "venv", "env", "build", "dist", "target", ".next", "vendor")
BUILTIN_CALLS = ("print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "isinstance", "super", "open", "type", "get", "append", "format")
MAX_FILE_BYTES = 1_048_576


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_test_path(path: Column) -> Column:
    return any_of([F.lower(path).contains(x) for x in TEST_PATHS])


def is_test_chunk(name: Column, decorators: Column) -> Column:
    return or_empty(name).startswith("test_") | or_empty(name).startswith("Test") | F.coalesce(F.arrays_overlap(decorators, F.array(*map(F.lit, TEST_DECORATORS))), F.lit(False))


def asks_for_tests(query: Column) -> Column:
    return F.lower(query).rlike("test|testing|spec|unittest")


def valid_name(name: Column, skip=("_", "if", "for", "new", "nil", "null", "undefined")) -> Column:
    return F.coalesce((F.length(name) >= 2) & name.rlike(r"^[\p{L}_]") & ~name.isin(*skip), F.lit(False))


def token_estimate(code: Column) -> Column:
    return F.floor(F.length(code) / 4).cast("int")


def content_hash(code: Column, size: int = 8) -> Column:
    return F.substring(F.md5(F.encode(code, "UTF-8")), 1, size)


def with_hash(text: Column, digest: Column) -> Column:
    return F.concat(text, F.lit(" ["), digest, F.lit("]"))


def without_hash(text: Column) -> Column:
    """Everything before the last `` [``."""
    return F.regexp_replace(text, r"(?s) \[(?!.* \[).*\z", "")


def clipped(text: Column, size: int) -> Column:
    """Null becomes ``""``; a longer text is cut and marked."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(or_empty(text))


def bare_type(t: Column) -> Column:
    """A Go type without its leading pointers and slices."""
    return F.regexp_replace(F.trim(t), r"^(?:\*|\[\d*\])+", "")


def qualifier(t: Column) -> Column:
    return F.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise("")


def unqualified(t: Column) -> Column:
    return F.regexp_replace(t, r"^[^.]*\.", "")


def is_internal_import(path: Column, module: Column) -> Column:
    inside = module.isNotNull() & (module != "") & path.startswith(module)
    return inside | ~any_of([path.startswith(h) for h in GO_EXTERNAL_HOSTS])


def import_dir(path: Column, module: Column) -> Column:
    """The directory of an import: below the module, ``.`` for the module itself, else without the first segment."""
    below = F.regexp_replace(F.expr("substring(from_path, length(module) + 1)"), "^/+", "")
    rest = F.when(path.contains("/"), F.regexp_replace(path, r"^[^/]*/", "")).otherwise(path)
    return F.when(module.isNotNull() & (module != "") & path.startswith(module), F.when(below == "", ".").otherwise(below)).otherwise(rest)


def java_import_path(path: Column) -> Column:
    """Null for a wildcard and for what comes from outside."""
    outside = any_of([path.startswith(p) for p in JAVA_EXTERNAL])
    return F.when(~(path.endswith(".*") | outside), F.translate(path, ".", "/"))


def dependency_name(path: Column) -> Column:
    """Third segment of an import from a known host, the second where there are two; else null."""
    parts = F.split(path, "/")
    known = any_of([path.startswith(h) for h in GO_EXTERNAL_HOSTS])
    return F.when(known & (F.size(parts) >= 3), F.get(parts, F.lit(2))).when(known & (F.size(parts) == 2), F.get(parts, F.lit(1)))


def package_clause(content: Column) -> Column:
    """Of Go files: the first line that is neither blank nor a comment, if it is a package clause."""
    return F.nullif(F.regexp_extract(content, r"\A(?:\s|//[^\n]*\n|/\*(?>(?s:.*?)\*/))*package[ \t]+(\w+)", 1), F.lit(""))


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def is_ignored(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS) + ")/")


def repo_name(identifier: Column) -> Column:
    """``owner__name`` of a URL, the last segment of a path, in lower case."""
    clean = F.regexp_replace(F.regexp_replace(identifier, "/+$", ""), r"\.git$", "")
    parts = F.split(clean, "/")
    last = F.element_at(parts, -1)
    return F.lower(F.when(identifier.rlike("^(https?|ssh|git)[:@]"), F.concat_ws("__", F.element_at(parts, -2), last)).otherwise(last))


def collection_name(repo: Column) -> Column:
    base = F.substring(F.lower(F.translate(repo, "/.", "__")), 1, 50)
    return F.concat(F.when(F.length(base) < 3, F.concat(base, F.lit("_db"))).otherwise(base), F.lit("_entities"))


def score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / 2)


def flow_name(kind: Column, route: Column, name: Column) -> Column:
    return F.when(or_empty(route) != "", F.trim(F.concat_ws(" ", kind, route))).otherwise(name)


# Fixed values of the two renderings: labels, their order, and the lengths at which texts are clipped.
CONTEXT_DOC, CONTEXT_CALLS, LLM_DOC = 300, 10, 200


def _said(label: str, c: str) -> Column:
    return F.when(or_empty(F.col(c)) != "", F.concat(F.lit(label), F.col(c)))


def context_string() -> Column:
    """What a chunk is, in lines; absent parts give no line."""
    listed = lambda label, arr: F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(arr, ", ")))
    params = F.transform("params", lambda p: F.concat(or_empty(p["name"]), F.lit(": "), F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("any"))))
    entry = F.concat_ws(" | ", F.concat(F.lit("Entry point type: "), or_empty(F.col("entry_point_type"))), _said("Route/topic: ", "entry_point_route"), _said("HTTP method: ", "entry_point_method"))
    return F.concat_ws(
        "\n",
        F.concat(or_empty(F.col("chunk_type")), F.lit(": "), or_empty(F.col("name"))),
        F.concat(F.lit("File: "), or_empty(F.col("file"))),
        _said("Signature: ", "signature"),
        F.when(or_empty(F.col("docstring")) != "", F.concat(F.lit("Description: "), clipped(F.col("docstring"), CONTEXT_DOC))),
        listed("Decorators: ", F.col("decorators")),
        listed("Parameters: ", params),
        _said("Returns: ", "returns"),
        listed("Calls: ", F.slice("calls", 1, CONTEXT_CALLS)),
        F.when(or_empty(F.col("parent")) != "", F.concat(F.lit("In: "), F.element_at(F.split("parent", "::"), -1))),
        F.when(F.col("is_entry_point"), entry),
        listed("Implements: ", F.col("implements")),
        _said("Package: ", "package_name"),
    )


def embedding_text() -> Column:
    own = F.col("use_contextual_embedding") & (or_empty(F.col("contextual_embedding_text")) != "")
    return F.when(own, F.col("contextual_embedding_text")).otherwise(F.concat_ws("\n\n", context_string(), or_empty(F.col("code"))))


def llm_context() -> Column:
    """A chunk as a model reads it: its situating context, a header, its whole code in a fence."""
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), or_empty(F.col("file")), F.lit(" (lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(") ["), or_empty(F.col("language")), F.lit("]")),
        F.when(or_empty(F.col("signature")) != "", F.concat(or_empty(F.col("chunk_type")), F.lit(": "), F.col("signature"))),
        F.when(or_empty(F.col("docstring")) != "", F.concat(F.lit("Doc: "), F.substring("docstring", 1, LLM_DOC))),
        F.when(F.col("is_entry_point"), F.concat_ws(" ", F.concat(F.lit("Entry point: "), or_empty(F.col("entry_point_type"))), _said("", "entry_point_method"), _said("", "entry_point_route"))),
    )
    return F.concat_ws(
        "\n",
        F.when(or_empty(F.col("situating_context")) != "", F.concat(F.lit("<context>\n"), F.col("situating_context"), F.lit("\n</context>\n"))),
        header,
        F.concat(F.lit("```"), or_empty(F.col("language")), F.lit("\n"), or_empty(F.col("code")), F.lit("\n```")),
    )


INTENTS = (
    # the first that matches counts
    ("overview", r"what (does|is) (this|the) (repo|project|codebase)|overview|summary|summarize"),
    ("entry_points", r"entry ?point|endpoint|route|api|main function"),
    ("feature", r"how does|how do|flow|feature|works?\b"),
    ("architecture", r"architecture|design|structure|diagram|component"),
    ("package", r"package|module|directory|folder"),
)


def intent(query: Column) -> Column:
    c = None
    for name, pattern in INTENTS:
        hit = F.lower(query).rlike(pattern)
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return c.otherwise("implementation")
