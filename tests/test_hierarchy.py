import random

import pytest
from pyspark.sql import functions as F

from treadle.operators import hierarchy as h

SCHEMA = "chunk_no long, repo string, id string, parent string, file string, no string"


def brute(rows):
    """chunk_no -> (root, depth, path, in_cycle, leads) by walking."""
    one = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None:
            k = (r[1], r[2])
            if k not in one or r[0] < one[k][0]:
                one[k] = r
    up = {}
    for (repo, _), r in one.items():
        p = one.get((repo, r[3])) if r[3] else None
        up[r[0]] = p[0] if p else None
    out = {}
    for n in up:
        way, seen = [n], {n}
        while up[way[-1]] is not None and up[way[-1]] not in seen:
            way.append(up[way[-1]])
            seen.add(way[-1])
        nxt = up[way[-1]]
        if nxt is None:
            out[n] = (way[-1], len(way) - 1, list(reversed(way)), False, False)
        else:
            out[n] = (None, None, None, nxt == n, True)
    return out


def check(spark, rows):
    got = {r.chunk_no: (r.root_no, r.depth, r.path, r.in_cycle, r.leads_to_cycle) for r in h.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want
    assert {r.chunk_no for r in h.cycle_members(spark.createDataFrame(rows, SCHEMA)).collect()} == {k for k, v in want.items() if v[3]}


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_and_rings(spark, seed):
    """Links over many files, so that most ways cross partitions."""
    rng = random.Random(seed)
    n = 150
    rows = []
    for i in range(n):
        p = rng.choice([None, "", "missing", *[f"k{rng.randrange(n)}" for _ in range(8)]])
        rows.append((i, rng.choice(["r", "r", "s"]), f"k{i}", p, f"f{rng.randrange(40)}", "clash"))
    check(spark, rows + rows[:20])


def test_long_chain_and_long_ring(spark):
    chain = [(i, "r", f"c{i}", f"c{i - 1}" if i else None, f"f{i}", None) for i in range(60)]
    ring = [(100 + i, "r", f"o{i}", f"o{(i + 1) % 37}", f"g{i % 5}", None) for i in range(37)]
    tail = [(200 + i, "r", f"t{i}", f"t{i - 1}" if i else "o5", f"h{i}", None) for i in range(20)]
    own = [(300, "r", "self", "self", "f", None), (301, "r", "below", "self", "z", None)]
    check(spark, chain + ring + tail + own)


def test_edge_cases(spark):
    check(spark, [(1, None, "a", "b", "f", None), (2, "r", None, "a", "f", None), (None, "r", "b", "a", "f", None), (3, "r", "a", "a2", None, None), (4, "r", "a", "x", "f", None)])
    assert h.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    assert h.cycle_members(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(h, "HOT_ROWS", 10)
    rows = [(i, "r", f"c{i}", f"c{i - 1}" if i else "c49", "one file", None) for i in range(50)]
    rows += [(100 + i, "r", f"d{i}", f"d{i // 2}" if i else None, "one file", None) for i in range(50)]
    assert h.placed(h.links(spark.createDataFrame(rows, SCHEMA))).select("home").distinct().count() > 3
    check(spark, rows)


@pytest.mark.parametrize("size", ["1", "20k", None])
def test_rings_do_not_depend_on_coalescing(spark, size):
    """Rings over many files, whatever partitions adaptive execution merges."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    if size:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    else:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rng = random.Random(5)
        rows = []
        for ring in range(60):
            n = rng.randrange(1, 9)
            rows += [(ring * 10 + i, "r", f"o{ring}.{i}", f"o{ring}.{(i + 1) % n}", f"f{rng.randrange(200)}", None) for i in range(n)]
        rows += [(1000 + i, "r", f"t{i}", rng.choice([None, f"o{rng.randrange(60)}.0", f"t{rng.randrange(i + 1)}"]), f"f{rng.randrange(200)}", None) for i in range(3000)]
        want = {k for k, v in brute(rows).items() if v[3]}
        assert {r.chunk_no for r in h.cycle_members(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_descendants(spark):
    rows = [(1, "r", "a", None, "f", None), (2, "r", "b", "a", "f", None), (3, "r", "c", "b", "g", None)]
    got = {tuple(r) for r in h.descendants(h.hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert F is not None
