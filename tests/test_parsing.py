from treadle.functions.chunking import split_at_boundaries
from treadle.functions.imports import imports_of
from treadle.functions.parsers import parse_file

GO = """package main
import (
  "fmt"
  db "github.com/lib/pq"
  // "not/this"
  _ "x/driver"
)
import m "x.test/app/models"
type UserServer struct {
}
func (s *UserServer) Get(ctx context.Context, a, b int) (*m.User, error) {
   repo := m.NewRepo(db)
   var q *Thing
   q.Run()
   s.repo.Find(a)
   help(a)
}
func handler(w http.ResponseWriter) {}
func init() { r.Handle("/x/:id", auth, handler); c.AddFunc("@daily", tidy); k.Subscribe([]string{"orders"}, eat) }
func tidy() {}
func eat() {}
func main() {}
"""
JAVA = """package a.b;
import java.util.List;
@RequestMapping("/api")
public class U extends B implements I {
  private final Repo repo;
  @GetMapping("/x")
  public List<User> get(final String id, @Q("x") int n) { return repo.find(id); }
  @RequestMapping(value = "/y", method = RequestMethod.POST)
  public void post(Body b) { b.run(); }
  @KafkaListener(topics = "t1")
  void eat() {}
  @RabbitListener(queues = "q")
  void drink() {}
}
"""
TS = """@Controller("c")
class K {
  @Get("/z")
  async find(id: string, n = 3): Promise<User> { const r = new Repo(); return r.load(id); }
}
export const h = async (req, res) => { helper(req); };
router.post("/p", auth, h);
bus.on("made", heard);
function heard(e) {}
"""
PY = """from a.b import C as D, e
@app.route("/x", methods=["get", "post"])
def f(x: D, *y) -> int:
    r = Repo()
    r.find(x); self.repo.go(); e(x)
@app.route("/any")
def any_(): pass
@consumer.consumer("topic")
def g(): pass
@app.head("/h")
def h(): pass
@app.on_event("start")
def no(): pass
"""


def rows(text, file, language):
    return {r["name"]: r for r in parse_file(text, file, language)}


def entry(r):
    return r["entry_point_type"], r["entry_point_route"], r["entry_point_method"]


def contexts(r):
    return [(c["receiver"], c["name"], c["receiver_type"], c["resolved"]) for c in r["calls_with_context"]]


def test_go():
    r = rows(GO, "a/b.go", "go")
    assert {k: entry(v) for k, v in r.items() if v["is_entry_point"]} == {
        "Get": ("grpc", "UserServer.Get", None), "handler": ("http", "/x/:id", "ANY"), "init": ("init", None, None), "tidy": ("cron", "@daily", None), "eat": ("kafka", "orders", None), "main": ("main", None, None)}
    g = r["Get"]
    assert g["params"] == [{"name": "ctx", "type": "context.Context"}, {"name": "a", "type": "int"}, {"name": "b", "type": "int"}] and g["returns"] == "(*m.User, error)"
    assert contexts(g) == [("m", "NewRepo", None, False), ("q", "Run", "*Thing", True), ("repo", "Find", "m.Repo", True), (None, "help", None, False)]
    assert (g["package_name"], g["receiver_type"]) == ("main", "UserServer")
    assert {k: v["from_path"] for k, v in g["imports_map"].items()} == {"fmt": "fmt", "db": "github.com/lib/pq", "m": "x.test/app/models"}
    assert g["imports"] == ["fmt", "github.com/lib/pq", "x/driver", "x.test/app/models"]
    assert not rows(GO.replace("package main", "package other"), "a/b.go", "go")["main"]["is_entry_point"]


def test_java():
    r = rows(JAVA, "U.java", "java")
    assert {k: entry(v) for k, v in r.items() if v["is_entry_point"]} == {"get": ("http", "/api/x", "GET"), "post": ("http", "/api/y", "POST"), "eat": ("kafka", "t1", None), "drink": ("event", "/api/", None)}
    assert r["get"]["params"] == [{"name": "id", "type": "String"}, {"name": "n", "type": "int"}] and r["get"]["returns"] == "List<User>"
    assert contexts(r["get"]) == [("repo", "find", "Repo", True)] and contexts(r["post"]) == [("b", "run", "Body", True)]


def test_typescript():
    r = rows(TS, "k.ts", "typescript")
    assert {k: entry(v) for k, v in r.items() if v["is_entry_point"]} == {"find": ("http", "/z", "GET"), "h": ("http", "/p", "POST"), "heard": ("event", "made", None)}
    assert r["find"]["params"] == [{"name": "id", "type": "string"}, {"name": "n", "type": "any"}] and r["find"]["returns"] == "Promise<User>"
    assert contexts(r["find"]) == [(None, "Repo", None, False), ("r", "load", "Repo", True)]


def test_python():
    r = rows(PY, "m.py", "python")
    assert {k: entry(v) for k, v in r.items() if v["is_entry_point"]} == {"f": ("http", "/x", "GET,POST"), "any_": ("http", "/any", "ANY"), "g": ("kafka", "topic", None), "h": ("http", "/h", "HEAD")}
    assert r["f"]["params"] == [{"name": "x", "type": "D"}, {"name": "y", "type": "any"}] and r["f"]["returns"] == "int"
    assert [c for c in contexts(r["f"]) if c[0] != "app"] == [(None, "Repo", None, False), ("r", "find", "Repo", True), ("repo", "go", None, False), (None, "e", None, False)]
    assert r["f"]["type_map"] == {"x": "D", "r": "Repo"}


def test_imports():
    assert imports_of("from a.b import (\n  C as D,\n  e,\n)\nfrom x import *\nimport os.path as op, sys # z\n", "python") == (["a.b.C", "a.b.e", "x.*", "os.path", "sys"], {"D": "a.b.C", "e": "a.b.e", "op": "os.path", "sys": "sys"})
    assert imports_of("import a, { b as c } from './x';\nimport * as n from 'm';\nimport type { T } from 't'\nconst q = require('y');", "typescript") == (["./x.b", "./x", "m", "t.T", "y"], {"c": "./x.b", "a": "./x", "n": "m", "T": "t.T", "q": "y"})
    assert imports_of("import static a.C.d;\nimport java.util.*;\nimport b.E;", "java") == (["a.C.d", "java.util.*", "b.E"], {"d": "a.C.d", "E": "b.E"})
    assert imports_of('import "one"\nimport (\n . "x/util"\n _ "side"\n)\n', "go") == (["one", "x/util", "side"], {"one": "one", "util": "x/util"})
    assert imports_of("", "go") == ([], {})


def test_boundaries():
    text = "x = 1\n" * 20 + "sub one {\n" + "  y();\n" * 20 + "}\nclass Two\n" + "  z\n" * 30 + "fn short\n"
    assert [(n, a, b) for n, a, b, _ in split_at_boundaries(text)] == [("block", 1, 20), ("one", 21, 42), ("Two", 43, 73)]
    assert split_at_boundaries("def only\n" + "x\n" * 90) == []
