import json
import re

import pandas as pd
from pyspark.sql import functions as F

from treadle.operators import levels, vector


def test_wildcards():
    match = lambda p, x: bool(re.match(levels.wildcard(p), x, re.S))
    assert match("@*.{get|post}(*)", "app.get('/x')") and match("@*.{get|post}(*)", "@r.post()") and not match("@*.{get|post}(*)", "app.getter()")
    assert match("@KafkaListener(*)", '@KafkaListener(topics = "a")') and not match("@KafkaListener(*)", "KafkaListeners()")
    assert match("a.b*", "a.b") and not match("a.b*", "axb")


def test_call_chain(spark):
    """First in, first out over the first five names, against a walk by hand."""
    rows = [("r", x, x.lower(), "f", i, list(c), x.isupper()) for i, (x, c) in enumerate([("A", "bcdefg"), ("b", "ga"), ("c", "x"), ("d", "c"), ("e", ""), ("f", ""), ("g", "h"), ("h", "b"), ("B", "h")])]
    n = spark.createDataFrame(rows + rows[:0], "repo string, id string, name string, file string, start_line int, calls array<string>, is_entry_point boolean")
    got: dict = {}
    for r in levels.call_chain(n).orderBy("entry", "step").collect():
        got.setdefault(r.entry, []).append(r.id)
    # "b" names the chunk that comes first by line
    assert got == {"A": list("Abcdefgh"), "B": list("BhbgA") + list("cdef")}


def test_grounded_and_migrated(spark):
    df = spark.createDataFrame([("load calls read", "load", ["x"]), ("load uses read", "load", ["read"]), ("load", "load", []), ("load", "load", ["x"]), ("other", "load", []), (None, "load", None)], "s string, n string, c array<string>")
    assert [r[0] for r in df.select(levels.grounded(F.col("s"), F.col("n"), F.col("c"))).collect()] == [True, True, True, False, False, False]
    old = spark.createDataFrame([(json.dumps(x),) for x in ({"a": "1", "reciever_type": "T", "z": 2}, {"receiver_type": "U", "reciever_type": "T"}, {})], "j string")
    got = [tuple(r[0]) for r in old.select(levels.migrated(F.col("j"), "a string, receiver_type string", {"reciever_type": "receiver_type"})).collect()]
    assert got == [("1", "T"), (None, "U"), (None, None)]


def test_assisted(spark):
    df = spark.createDataFrame([("r", "1", "f", ["@app.get('/x')"]), ("r", "2", "main", []), ("r", "3", "g", None), ("r", "4", "h", ["@cache"])], "repo string, id string, name string, decorators array<string>")
    assert {(r.id, r.type) for r in levels.assisted(df).collect()} == {("1", "http_endpoint"), ("2", "main")}
    assert {r.id for r in levels.assisted(df, 0.8).collect()} == {"1"}


def test_http_provider():
    seen = []

    def post(url, body, headers):
        texts = json.loads(body)["input"]
        seen.append(len(texts))
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]})

    texts = ["x" * i for i in range(70)] + [None]
    out = list(vector.http_embedding("http://u", "m", "k", post=post)(iter([pd.Series(texts)])))
    assert out[0].tolist() == [[float(len(t or ""))] for t in texts] and seen == [32, 32, 7]
