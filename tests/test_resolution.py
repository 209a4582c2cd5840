from treadle.operators import resolution

N = (
    "repo string, id string, name string, file string, language string, start_line int, parent string, package_name string, chunk_type string, "
    "imports_map map<string,struct<from_path:string,name:string>>, calls_with_context array<struct<name:string,receiver:string,receiver_type:string,resolved:boolean>>, key string"
)


def chunk(id, name, file, lang="python", line=1, parent=None, pkg=None, kind="function", imports=None, calls=None):
    return ("r", id, name, file, lang, line, parent, pkg, kind, imports and {k: (v, k) for k, v in imports.items()}, calls, "clash")


def resolved(spark, rows, mods=(), **kw):
    n = spark.createDataFrame(rows, N)
    m = spark.createDataFrame(list(mods), "repo string, module string")
    return {(r.id, r.call): (r.target, r.rule) for r in resolution.resolve_calls(n, m, **kw).collect()}


def test_general_rules(spark):
    rows = [
        chunk("box", "Box", "a/box.py", kind="class"), chunk("box.open", "open", "a/box.py", line=3, parent="box"), chunk("open", "open", "a/box.py", line=2),
        chunk("caller", "main", "b/main.py", imports={"Box": "a.box", "helper": "..a.util"}, calls=[
            ("open", "x", "Box", True), ("helper", None, None, False), ("local", "", "", None), ("main", None, None, False), ("gone", None, None, False), ("open", "y", None, False)]),
        chunk("local", "local", "b/main.py", line=9), chunk("helper", "helper", "a/util/__init__.py"),
        chunk("js", "run", "web/app/run.js", "javascript", imports={"tool": "../lib/tool", "ext": "ext"}, calls=[("tool", None, None, False), ("ext", None, None, False)]),
        chunk("tool", "tool", "web/lib/tool/index.js", "javascript"),
        chunk("j", "J", "src/main/java/d/J.java", "java", imports={"K": "d.e.K"}, calls=[("go", "k", "K", True)]),
        chunk("k", "K", "src/main/java/d/e/K.java", "java", kind="class"), chunk("k.go", "go", "src/main/java/d/e/K.java", "java", 4, "k"),
    ]
    want = {("caller", "open"): ("box.open", 1), ("caller", "helper"): ("helper", 2), ("caller", "local"): ("local", 3), ("js", "tool"): ("tool", 2)}
    assert resolved(spark, rows + rows[:0]) == want
    assert resolved(spark, rows, roots=("", "src/main/java/")) == want | {("j", "go"): ("k.go", 1)}
    assert resolved(spark, []) == {}


def test_go_rules(spark):
    go = lambda *a, **k: chunk(*a, "go", **k)
    imports = {"m": "x.test/app/model-set", "other": "x.test/app/other"}
    rows = [
        go("main", "main", "cmd/main.go", pkg="main", imports=imports, calls=[
            ("Find", "repo", "*m.Repo", True), ("New", "other", None, True), ("Skip", "who", None, False), ("help", None, None, False), ("Do", "s", "[]*Svc", True), ("Run", "z", "*Absent", True), ("Lost", "q", "zz.T", True)]),
        go("find", "Find", "model-set/repo.go", pkg="models", line=4), go("find2", "Find", "model-set/sub.go", pkg="models"),
        go("new", "New", "other/new.go", pkg="other"), go("skip", "Skip", "cmd/skip.go", pkg="main"), go("help", "help", "cmd/help.go", pkg="main"),
        go("do0", "Do", "cmd/a.go", pkg="main"), go("do", "Do", "cmd/b.go", pkg="main", parent="cmd/b.go::struct::Svc"), go("run", "Run", "cmd/b.go", pkg="main", line=7),
        go("lost", "Lost", "cmd/b.go", pkg="main", line=8), go("nopkg", "help", "odd/x.go", pkg=""),
    ]
    # of a package's symbol the last counts, of a caller's package the first
    want = {("main", "Find"): ("find2", 1), ("main", "New"): ("new", 2), ("main", "help"): ("help", 3), ("main", "Do"): ("do", 1), ("main", "Run"): ("run", 1)}
    assert resolved(spark, rows, [("r", "x.test/app"), ("r", "")]) == want
    n = spark.createDataFrame(rows, N)
    got = {tuple(r) for r in resolution.resolve_imports(n, spark.createDataFrame([("r", "x.test/app")], "repo string, module string")).selectExpr("src", "dst", "attr").collect()}
    assert got == {("main", "find", imports["m"]), ("main", "find2", imports["m"]), ("main", "new", imports["other"])}
