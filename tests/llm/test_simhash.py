"""SimHash against all pairs."""

import numpy as np
import xxhash
from conftest_llm import EDGES

from quillspark.llm import simhash
from quillspark.llm.common import Scratch
from quillspark.llm.components import components
from quillspark.sources.tables import table


def plain_mark(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    found = [w for w in lower.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(marks, budget=3):
    least = {m: m for m in marks}

    def find(m):
        while least[m] != m:
            m = least[m]
        return m

    marks = sorted(set(marks))
    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def check(docs):
    rows = docs.collect()
    marks = [plain_mark(r.text) for r in rows]
    group = plain_groups(marks)
    low = {}
    for r, m in zip(rows, marks, strict=True):
        if r.doc_id is not None:
            low[group[m]] = min(low.get(group[m], r.doc_id), r.doc_id)
    got = simhash.near_groups(docs).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, m, low.get(group[m], -1)) for r, m in zip(rows, marks, strict=True))
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.mark % 2**64, -1 if g.component_id is None else g.component_id) for g in got) == want


def test_groups_equal_all_pairs(spark, sf):
    check(table(spark, sf, "documents"))


def test_edges(spark, make):
    check(make([*EDGES, (None, "only null id here now", "en", "s"), (5, "same text here", "en", "s")]))
    assert simhash.near_groups(make([])).count() == 0


def test_walk_and_cuts_find_every_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    marks = set(map(int, rng.integers(0, 2**64, 300, dtype=np.uint64)))
    for c in map(int, centres):
        for _ in range(60):
            m = c
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                m ^= 1 << int(bit)
            marks.add(m)
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    df = spark.createDataFrame(signed, "mark long")
    want = plain_groups(marks)
    for unit in (20_000, 5):  # 5: units are cut again and again
        found = {r.node % 2**64: r.component % 2**64 for r in components(simhash.links(df, unit=unit)).collect()}
        groups = {}
        for m in marks:
            groups.setdefault(want[m], set()).add(found.get(m, m))
        assert all(len(x) == 1 for x in groups.values())
        assert len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_units_are_bounded(spark):
    near = [((1 << 60) + i,) for i in range(3000)]  # a cube of close fingerprints
    work = simhash.units(spark.createDataFrame(near, "mark long"), Scratch(spark), unit=100)
    assert work.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3000
    found = components(simhash.links(spark.createDataFrame(near, "mark long"), unit=100))
    assert found.select("component").distinct().count() == 1 and found.count() == 3000


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(9)
    for dense in (12, 20, 60):
        keys = rng.integers(0, 3, 400)
        marks = rng.integers(0, 2**dense, 400, dtype=np.uint64) << np.uint64(2)
        pairs = {}
        for key, mark in zip(keys.tolist(), marks.tolist(), strict=True):
            pairs.setdefault(key, set()).add(mark)
        flat = [(key, mark) for key, found in pairs.items() for mark in found]
        a, b = simhash.walk(np.array([x for x, _ in flat]), np.array([x for _, x in flat], np.uint64), 3)
        root = list(range(len(flat)))
        for child, top in zip(a.tolist(), b.tolist(), strict=True):
            root[child] = top
        for key, found in pairs.items():
            want = plain_groups(found)
            seen = {}
            for i, (x, mark) in enumerate(flat):
                if x == key:
                    seen.setdefault(want[mark], set()).add(root[i])
            assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)


def test_a_dense_unit_stays_small():
    import tracemalloc

    for spread in (1, 3):  # a full cube; every third number, so that few are one bit apart
        marks = np.arange(0, (1 << 19) * spread, spread, dtype=np.uint64)
        tracemalloc.start()
        a, b = simhash.walk(np.zeros(len(marks), np.int64), marks, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1 << 30 and len(a) == len(marks) - 1 and len(set(b.tolist())) == 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1300)} == {1000} and found[5000] == 5000
