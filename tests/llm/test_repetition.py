import random
import re

import pyarrow as pa

from treadle.llm import repetition as rp


def brute(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if g in grams[:i]:
            hit |= set(range(i, i + 5))
    return len(words), len(hit)


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") + rng.choice(["", ".", "\n", "_x"]) for _ in range(rng.randrange(80))) for _ in range(100)]
    texts += [None, "", " \n ", "!!!", "Ünï cödé ١٢٣ x y z " * 4, "a b c d e a b c d e", "one two three four", "東京 大阪 東京 大阪 " * 3]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lines string")
    got = {r.doc_id: (r.n_words, r.n_repeated) for r in rp.line_records(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    found = {r.doc_id for r in rp.repetitive(df.unionByName(df)).collect()}
    assert found == {i for i, t in enumerate(texts) if brute(t)[0] and brute(t)[1] / brute(t)[0] >= 0.3 - 1e-12}


def test_lines(spark):
    text = "Home | Docs | Blog | About\nThis is a whole sentence of text.\nthis line just stops without any end\n© 2020 somebody\n" + "all of it is the same again.\n" * 3
    r = rp.cleaned(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    by = {x.doc_id: x for x in r}
    assert (by[1].n_navigation, by[1].n_boilerplate, by[1].n_open_end, by[1].n_repeating) == (1, 1, 1, 2)
    assert by[1].n_removed == 5 and by[1].rejected
    assert (by[2].n_words, by[2].lost_share, by[2].rejected) == (0, 0.0, False) and not by[3].rejected
    assert rp.repetitive(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_recur_in_the_corpus(spark):
    """In any language, whatever their numbers; lines of few documents are none."""
    footer = "Siehe auch die Hinweise auf Seite {}."
    rows = [(i, f"Der Satz Nummer {'x' * i} steht nur hier.\n{footer.format(i)}\n") for i in range(12)]
    rows += [(50 + i, f"Nur {'y' * i} wenige haben das.\nEine Zeile von dreien hier.") for i in range(3)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows + rows[:2] + [(None, footer.format(3))], "doc_id long, text string")
    got = {}
    for r in rp.cleaned(df).collect():
        got.setdefault(r.doc_id, []).append(r.n_boilerplate)
    assert got == {i: [1, 1] if i < 2 else [1] for i in range(12)} | {50 + i: [0] for i in range(3)} | {90: [0], 91: [0], None: [0]}


def test_found_from_judged_lines(monkeypatch):
    seen = []
    monkeypatch.setattr(rp, "judged_lines", lambda t, judge=rp.judged_lines: seen.append(t) or judge(t))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e\n" * 2, None])], names=["id", "text"])
    (out,) = rp._judge(False)([batch])
    assert out.to_pylist() == [{"id": 1, "n_words": 10, "n_repeated": 5}, {"id": 2, "n_words": 0, "n_repeated": 0}]
    assert seen == ["a b c d e\n" * 2]
