from datetime import datetime as D

from treadle.operators import orphans as o

CHUNKS = (
    "chunk_no long, repo string, id string, name string, file string, language string, calls array<string>, "
    "imports_map map<string,struct<from_path:string,name:string>>, parent string, indexed_at timestamp, key string, e int"
)
DEL, MOD, EXT = "repo string, id string, deleted_at timestamp", "repo string, module string", "language string, kind string, symbol string"


def run(spark, chunks, deletes=(), mods=(), ext=()):
    dfs = [spark.createDataFrame(list(x), s) for x, s in ((chunks, CHUNKS), (deletes, DEL), (mods, MOD), (ext, EXT))]
    got = [tuple(r) for r in o.orphan_references(*dfs).drop("e").collect()]
    assert len(got) == len(set(got))
    return set(got)


def row(no, name="n", file="a/x.py", lang="python", calls=None, imports=None, parent=None, at=D(2024, 3, 5), repo="r", id=None):
    imports = None if imports is None else {f"k{i}": (p, "x") for i, p in enumerate(imports)}
    return (no, repo, id or f"id{no}", name, file, lang, calls, imports, parent, at, "clash", 7)


def test_later_deleted_and_missing(spark):
    rows = [
        row(1, calls=["later", "same_month", "gone", "gone_later", "never", "ext", "self", None, ""], name="self"),
        row(2, "later", at=D(2024, 4, 1)),
        row(3, "same_month", at=D(2024, 3, 31)),
        row(4, "gone", at=D(2024, 1, 1)),
        row(5, "gone_later", at=D(2024, 1, 1)),
        row(6, "other", repo="s", calls=["self"]),
        row(7, calls=["x"], at=None),
    ]
    gone = [("r", "id4", D(2024, 3, 20)), ("r", "id4", D(2024, 9, 1)), ("r", "id5", D(2024, 4, 1)), ("r", None, None)]
    got = run(spark, rows + rows[:1], gone, ext=[("python", "call", "ext"), ("go", "call", "never")])
    assert got == {("calls", 1, "later"), ("calls", 1, "gone"), ("calls", 1, "never"), ("calls", 6, "self")}


def test_deleted_rows_do_not_refer(spark):
    assert run(spark, [row(1, calls=["x"]), row(2, parent="nope")], [("r", "id1", D(2024, 3, 9))]) == {("parent", 2, "nope")}


def test_imports(spark):
    rows = [
        row(1, file="p/m.py", imports=["a.b.c", "a.b", "a.z.q", "os.path", "os", "osx"]),
        row(2, file="a/b.py"),
        row(3, file="src/ui/v.ts", lang="typescript", imports=["../lib/w", "./none", "../lib/./w.js", "fs"]),
        row(4, file="src/lib/w.js", lang="javascript"),
        row(5, file="cmd/m.go", lang="go", imports=["ex.org/m/pkg/x", "ex.org/m/pkg", "fmt", "ex.org/mm"]),
        row(6, file="pkg/x/one.go", lang="go"),
        row(7, file="src/main/java/d/E.java", lang="java", imports=["d.E", "d.F", "java.util.List"]),
        row(8, file="c.yaml", lang="yaml", imports=["whatever"]),
    ]
    ext = [("python", "package", "os"), ("typescript", "package", "fs"), ("go", "package", "fmt"), ("java", "package", "java.util")]
    got = run(spark, rows, mods=[("r", "ex.org/m")], ext=ext)
    assert got == {
        ("imports_map", 1, "a.z.q"), ("imports_map", 1, "osx"), ("imports_map", 1, "a.b") if False else ("imports_map", 3, "./none"),
        ("imports_map", 5, "ex.org/m/pkg"), ("imports_map", 5, "ex.org/mm"), ("imports_map", 7, "d.F"),
    }


def test_empty(spark):
    assert run(spark, []) == set()
