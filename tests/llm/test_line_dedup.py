"""Line dedup against all pairs of positions."""

import numpy as np
from conftest_llm import EDGES

from quillspark.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def plain(rows, least):
    """rows: (doc_id, text) in order of place; the cleaned texts."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    lines = {i: [x for x in (rows[i][1] or "").split("\n") if x.strip(SPACES)] for i in order}
    places = [(i, j) for i in order for j in range(len(lines[i]))]
    gone = set()
    for b, (i, j) in enumerate(places):
        for x, y in places[:b]:
            n = 0
            while j + n < len(lines[i]) and y + n < len(lines[x]) and lines[i][j + n] == lines[x][y + n]:
                n += 1
            if n and sum(len(z.encode().split()) for z in lines[i][j : j + n]) >= least:
                gone |= {(i, j + m) for m in range(n)}
    out = []
    for i, (_, text) in enumerate(rows):
        if text is None:
            out.append((None, 0, 0))
            continue
        number, kept, n = -1, [], 0
        for line in text.split("\n"):
            if line.strip(SPACES):
                number += 1
                if (i, number) in gone:
                    n += 1
                    continue
            kept.append(line)
        out.append(("\n".join(kept) if n else text, number + 1, n))
    return out


def check(docs, least=10):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = line_dedup.dedup_lines(docs, least).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(d, *x) for (d, _), x in zip(rows, plain(rows, least), strict=True)]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=key) == sorted(want, key=key)
    assert set(docs.columns) <= set(got[0].asDict()) if got else True


def test_random_lines(spark, make):
    rng = np.random.default_rng(5)
    words = ["a", "b c", "d e f g", "h i j k l m n o p q r", "", "  ", "s t"]
    texts = ["\n".join(rng.choice(words, rng.integers(0, 14))) for _ in range(60)]
    for least in (1, 4, 10, 25):
        check(make(texts).repartition(5, "doc_id"), least)


def test_runs_across_short_lines(spark, make):
    run = "one two three\nfour five\nsix seven eight nine ten\neleven"
    check(make([f"intro x\n{run}\nend y", f"{run}", f"other\n\n{run}\n{run}", "four five\nsix seven eight nine ten", "four five"]))


def test_passages_of_fifty_words(spark, make):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = make([f"clean start {i}\n{passage}\nclean end {i}" for i in range(30)] + ["nothing shared here at all, just one line of words"])
    got = sorted(line_dedup.dedup_lines(docs).collect(), key=lambda r: r.doc_id)
    assert passage in got[0].text and all(passage not in r.text for r in got[1:])
    assert all(r.text == f"clean start {r.doc_id}\nclean end {r.doc_id}" for r in got[1:30])


def test_clashing_columns_survive(make):
    run = "one two three four five six seven eight nine ten eleven"
    docs = make([run, f"x\n{run}"]).selectExpr("*", "5L AS n_lines", "'r' AS __row", "'g' AS __gone", "'p' AS `a.b`")
    got = sorted(line_dedup.dedup_lines(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_lines, r["__row"], r["__gone"], r["a.b"], r._n_lines, r.n_removed) for r in got] == [(5, "r", "g", "p", 1, 0), (5, "r", "g", "p", 2, 1)]
    assert got[1].text == "x"


def test_one_very_common_line(make):
    common = "a line of at least ten words that stands in very many documents"
    docs = make([f"{common}\nown line {i} of ten words that no other document of these has at all" for i in range(400)])
    got = line_dedup.dedup_lines(docs).where("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_edges(spark, make):
    check(make([*EDGES, (None, "one two three four five six seven eight nine ten", "en", "s"), (3, "one two three four five six seven eight nine ten", "en", "s")]))
    assert line_dedup.dedup_lines(make([])).count() == 0
