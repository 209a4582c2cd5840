import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from treadle.functions import parsers, paths, text
from treadle.operators import components, graph, store
from treadle.plans import catalogue
from treadle.sources.files import go_module, scan_tree
from treadle.streaming.ingest import SOURCE, ingest


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("t", "bare"), [("*models.User", "models.User"), ("[]*models.User", "models.User"), ("[4]*models.User", "models.User"), ("[][]string", "string"), ("map[string]*User", "map[string]*User"), ("chan *User", "chan *User")]
)
def test_bare_type(spark, t, bare):
    assert one(spark, text.bare_type(F.col("t")), t=t) == bare


def test_scalars(spark):
    c = F.col("x")
    assert one(spark, text.repo_name(c), x="https://example.com/Owner/My.Repo.git") == "owner__my.repo"
    assert one(spark, text.repo_name(c), x="/a/b/Thing/") == "thing"
    assert one(spark, text.collection_name(c), x="Owner/My.Repo") == "owner_my_repo_entities"
    assert one(spark, text.collection_name(c), x="ab") == "ab_db_entities"
    assert one(spark, text.dependency_name(c), x="github.com/gin-gonic/gin") == "gin"
    assert one(spark, text.without_hash(c), x="a [b] c [12345678]") == "a [b] c"
    assert one(spark, paths.folded_path(c), x="a/b/../c/./d") == "a/c/d"
    assert one(spark, paths.python_module_path(c, F.col("d")), x="..m.n", d="a/b") == "a/m/n"
    assert one(spark, text.is_test_path(c), x="src/latest_x.py") is True
    assert one(spark, text.asks_for_tests(c), x="Where are the Specs?") is True
    assert one(spark, text.package_clause(c), x="// c\n\npackage auth\n") == "auth"
    for d, s in ((0.0, 1.0), (1.0, 0.5), (3.0, 0.0)):
        assert spark.range(1).select(text.score(F.lit(d))).first()[0] == s


def test_components_against_union_find(spark):
    rng = random.Random(1)
    e = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3), (900, 901), (900, 901)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def bfs(seeds, size, file, near, budget):
    """The expansion, one node at a time."""
    queue, seen, used, out = list(seeds), set(seeds), 0, []
    while queue and used < budget:
        x = queue.pop(0)
        if used + size[x] > budget:
            continue
        used += size[x]
        out.append(x)
        more = [y for y, _ in sorted(near.get(x, {}).items(), key=lambda z: (z[1], z[0]))]
        if used * 2 < budget:
            more += [y for y in sorted(size) if file[y] == file[x] and y != x][:5]
        for y in more:
            if y not in seen and y in size:
                seen.add(y)
                queue.append(y)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_budgeted_expansion(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(24)]
    size, file = {x: rng.randrange(1, 60) for x in ids}, {x: f"f{rng.randrange(6)}" for x in ids}
    calls = {(rng.choice(ids), rng.choice(ids)) for _ in range(30)}
    near: dict = {}
    for a, b in calls:
        near.setdefault(a, {})[b] = 1
    n = spark.createDataFrame([("r", x, file[x], size[x]) for x in ids], "repo string, id string, file string, size int")
    e = spark.createDataFrame([("r", a, b, "CALLS") for a, b in calls], "repo string, src string, dst string, rel string")
    seeds = spark.createDataFrame([("q", "r", ids[3], 1), ("q", "r", ids[9], 2), ("q", "r", "gone", 3)], "query_id string, repo string, id string, at int")
    got = graph.budgeted_expansion(seeds, n, e, budget=200).orderBy("position").collect()
    assert [r.id for r in got] == bfs([ids[3], ids[9]], size, file, near, 200)
    assert sum(r.tokens for r in got) <= 200


def test_expansion_of_a_long_chain_and_a_hub(spark):
    """More levels than any limit, and a queue whose large nodes never fit."""
    ids = [f"n{i:02d}" for i in range(17)]
    hub = [f"h{i:03d}" for i in range(200)]
    size = {x: 1 for x in ids} | {x: (i * 7) % 40 for i, x in enumerate(hub)}
    calls = list(zip(ids, ids[1:])) + [(ids[-1], x) for x in hub]
    near: dict = {}
    for a, b in calls:
        near.setdefault(a, {})[b] = 1
    n = spark.createDataFrame([("r", x, x, size[x]) for x in ids + hub], "repo string, id string, file string, size int")
    e = spark.createDataFrame([("r", a, b, "CALLS") for a, b in calls], "repo string, src string, dst string, rel string")
    seeds = spark.createDataFrame([("q", "r", ids[0], 1)], "query_id string, repo string, id string, at int")
    got = [r.id for r in graph.budgeted_expansion(seeds, n, e, budget=120).orderBy("position").collect()]
    assert got == bfs(ids[:1], size, {x: x for x in size}, near, 120) and set(ids) < set(got)


def test_flows(spark):
    n = spark.createDataFrame([("r", x, x.isupper()) for x in "ABcdefg"], "repo string, id string, is_entry_point boolean")
    e = spark.createDataFrame([("r", a, b) for a, b in ("Ac", "Ad", "AB", "ce", "cd", "df", "eA", "Bg", "fg")], "repo string, src string, dst string")
    flows: dict = {}
    for r in graph.detect_flows(n, e).orderBy("entry", "step").collect():
        flows.setdefault(r.entry, []).append(r.id)
    assert flows == {"A": list("Acdefg"), "B": list("Bg")}
    assert graph.detect_flows(n, e, steps=3).where("entry = 'A'").count() == 3


PY = '''import os
from models import User

class UserService(Base):
    """Users."""
    def find(self, repo: UserRepo, uid):
        return repo.get_by_id(uid)

@app.route("/users", methods=["GET", "post"])
def list_users():
    svc = UserService()
    return svc.find(None, 1)

def main():
    list_users()

if __name__ == "__main__":
    main()
'''
GO = 'package auth\n\nimport (\n\t"example.com/app/store"\n)\n\ntype AuthService struct {\n\trepo int\n}\n\n// Login logs in.\nfunc (s *AuthService) Login(name string) error {\n\treturn find(name) // }\n}\n\nfunc LoginHandler(w Writer) {\n\tsvc := NewAuthService()\n}\n\nfunc Routes(router Router) {\n\trouter.POST("/login", LoginHandler)\n}\n'
JAVA = '@RequestMapping("/api")\npublic class UserController implements Api {\n    private UserRepo repo;\n\n    @GetMapping("/{id}")\n    public User one(String id) {\n        return repo.findById(id);\n    }\n\n    private void handle(String msg) { if (x) { y(); } }\n}\n'
JS = "import { Store } from './store';\n\nfunction listItems(req, res) { const s = new Store(); return s.load(); }\nconst saveItem = (req, res) => { validate(req); };\nfunction validate(req) { return true; }\n\napp.get('/items', listItems);\nrouter.post('/items', saveItem);\n"


def test_parsers(spark):
    files = [("r", "svc/api.py", PY), ("r", "a/service.go", GO), ("r", "src/U.java", JAVA), ("r", "web/r.js", JS), ("r", "bad.py", "def ("), ("r", "n.py", None), ("r", "x.rb", "def a\n" * 20)]
    rows = {r.id or r.file: r for r in parsers.parse_sources(spark.createDataFrame(files, SOURCE)).collect()}
    py = "svc/api.py::"
    assert {k[len(py) :]: (r.chunk_type, r.start_line, r.end_line) for k, r in rows.items() if k.startswith(py)} == {
        "class::UserService": ("class", 4, 7), "method::find": ("method", 6, 7), "function::list_users": ("function", 10, 12), "function::main": ("function", 14, 15), "function::__main__": ("function", 1, 19)}
    r = rows[py + "function::list_users"]
    assert (r.entry_point_type, r.entry_point_route, r.entry_point_method, r.calls) == ("http", "/users", "GET,POST", ["UserService", "find"])
    assert rows[py + "method::find"].parent == py + "class::UserService"
    go = rows["a/service.go::method::Login"]
    assert (go.parent, go.docstring, go.start_line, go.end_line) == ("a/service.go::struct::AuthService", "Login logs in.", 12, 14)
    h = rows["a/service.go::function::LoginHandler"]
    assert (h.entry_point_type, h.entry_point_route, h.entry_point_method, h.imports) == ("http", "/login", "POST", ["example.com/app/store"])
    assert rows["src/U.java::class::UserController"].implements == ["Api"]
    o = rows["src/U.java::method::one"]
    assert (o.entry_point_method, o.entry_point_route, o.calls, o.parent) == ("GET", "/api/{id}", ["findById"], "src/U.java::class::UserController")
    assert rows["web/r.js::function::saveItem"].calls == ["validate"] and rows["web/r.js::function::saveItem"].entry_point_method == "POST"
    assert rows["bad.py"].error.startswith("SyntaxError") and rows["x.rb::block::L1"].chunk_type == "block" and "n.py" not in {r.file for r in rows.values()}


def test_scan_store_and_stream(spark, tmp_path):
    root = tmp_path / "tree"
    for p, b in (("a.py", b"def f():\n    return 1\n"), ("node_modules/x.py", b"x = 1"), ("b.bin", b"\x00"), ("c.py", b"\xff\xfe"), ("go.mod", b"module ex.org/m\n")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    scanned = scan_tree(spark, str(root), "r")
    assert [r.path for r in scanned.collect()] == ["a.py"]
    assert go_module(scan_tree(spark, str(root), "r", known_only=False)).first().module == "ex.org/m"
    inbox, path = str(tmp_path / "in"), str(tmp_path / "store")
    scanned.write.mode("append").parquet(inbox)
    ingest(spark, inbox, path, f"t{random.random()}").awaitTermination()
    name = f"u{random.random()}"
    spark.createDataFrame([("s", "b.py", "def g(): pass"), ("s", "b.py", "def g(): pass")], SOURCE).write.mode("append").parquet(inbox)
    ingest(spark, inbox, path, name).awaitTermination()
    spark.createDataFrame([("r", "a.py", "def f():\n    return 2\n")], SOURCE).write.mode("append").parquet(inbox)
    ingest(spark, inbox, path, name).awaitTermination()
    got = {(r.repo, r.name, r.code.split()[-1]) for r in store.read(spark, path).collect()}
    assert got == {("r", "f", "2"), ("s", "g", "pass")}
    store.delete_repo(spark, path, "s")
    assert not store.has_repo(store.read(spark, path), "s") and store.has_repo(store.read(spark, path), "r")


def test_package_clause_below_a_block_comment(spark, tmp_path):
    files = {"a.go": "/* Licence **/\n// x\npackage a\n", "b.go": "package b\n", "c.go": "/* x */ y /* z */\npackage c\n", "d.go": "/*" + " long *\n" * 5000 + "*/\npackage d\n"}
    spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = catalogue.queries()["package_clause_any_header"](spark, str(tmp_path)).collect()
    assert {(r.path, r.package) for r in got} == {("a.go", "a"), ("b.go", "b"), ("d.go", "d")}


def test_upsert_of_whole_tables(spark, sf_dir):
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    last = {}
    for r in chunks.select("repo", "id", "code", "loaded_at").collect():
        last.setdefault((r.repo, r.id), []).append((r.loaded_at, r.code))
    got = {(r.repo, r.id): (r.loaded_at, r.code, r.origin) for r in catalogue.queries()["upsert_redelivered"](spark, sf_dir).collect()}
    assert got == {k: (*max(v, key=lambda x: x[0]), "new" if len(v) > 1 else "old") for k, v in last.items()}


def test_queries_match_sql(spark, sf_dir):
    """All core queries that SQL can express, on the smallest tables."""
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else v if v is None else str(v)
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, sf_dir)
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns), name
        want = sorted(([norm(x[cols.index(c)]) for c in sorted(cols)] for x in r.fetchall()), key=repr)
        assert sorted(([norm(x[c]) for c in sorted(cols)] for x in df.collect()), key=repr) == want, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
