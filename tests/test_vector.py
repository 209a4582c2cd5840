import random

import pytest

from treadle.operators import vector


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_nearest_both_ways(spark, monkeypatch, sent):
    """Against brute force, with ties, nulls, equal rows and blocks smaller than the table."""
    monkeypatch.setattr(vector, "NUMBERS_SENT", sent)
    monkeypatch.setattr(vector, "BLOCK", 16)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(60)] + [(99, None)]
    q = [r for r in rows if r[0] % 5 == 0] + [(100, None)]
    make = lambda x: spark.createDataFrame(x, "id long, v array<float>")
    got = {}
    for r in vector.nearest(make(q), make(rows), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    want = {}
    for a, v in q:
        if v:
            best = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), b) for b, w in rows if w)[:4]
            want[a] = [(i + 1, b, d) for i, (d, b) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert vector.nearest(make([]), make(rows), 4).count() == 0 == vector.nearest(make(q), make([]), 4).count()
