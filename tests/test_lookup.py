"""Index and lookup: ranking, grouping, limits, children, statuses."""

from pyspark.sql import functions as F

from quillspark.plans import index, lookup

POSTING = "norm string, entry_id string, sense_id string, match string, headword string, key_raw string, ord long"


def tables(spark, rows, entries):
    postings = index.with_head_keys(spark.createDataFrame(rows, POSTING))
    return postings, spark.createDataFrame(entries, "id string, headword string, kind string, parent_id string")


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_period_keys_rank_their_own_headword_first(spark):
    rows = [(k, e, None, "headword", h, h, i) for i, (k, e, h) in enumerate([("u", "u1", "U"), ("u.", "u2", "U."), ("u", "u2", "U.")])]
    postings, entries = tables(spark, rows, [("u1", "U", "word", None), ("u2", "U.", "word", None)])
    got = {(r.qid, r.place): r.entry_id for r in lookup.lookup(ask(spark, "U.", "U"), postings, entries).collect()}
    assert got[0, 1] == "u2" and got[1, 1] == "u1"


def test_exactness_beats_rank_and_senses_union_unless_whole(spark):
    rows = [("run", "earth", "e#s1", "phrase", "earth", "run", 0), ("run", "earth", "e#s2", "collocation", "earth", "run", 1), ("run", "run", None, "alias", "run", "run", 2), ("run", "run", "r#s1", "phrase", "run", "run", 3)]
    postings, entries = tables(spark, rows, [("earth", "earth", "word", None), ("run", "run", "word", None), ("run-up", "run up", "phrasal_verb", "run"), ("runner", "runner", "derived", "run")])
    got = sorted(lookup.lookup(ask(spark, "run"), postings, entries).collect(), key=lambda r: r.place)
    assert [(r.entry_id, r.match, r.whole, r.sense_ids) for r in got] == [("run", "alias", True, []), ("earth", "phrase", False, ["e#s1", "e#s2"])]
    assert got[0].related == ["run-up"] and got[1].related == []
    cli = sorted(lookup.lookup(ask(spark, "run"), postings, entries, dialect="cli").collect(), key=lambda r: r.place)
    assert [(r.entry_id, r.sense_ids) for r in cli] == [("run", []), ("earth", ["e#s1"])]


def test_limits_and_missing_entries(spark):
    rows = [("k", f"e{i:03}", None, "headword", f"h{i:03}", "k", i) for i in range(40)]
    postings, entries = tables(spark, rows, [(f"e{i:03}", f"h{i:03}", "word", None) for i in range(40) if i != 2])
    product = lookup.lookup(ask(spark, "k"), postings, entries).collect()
    assert len(product) == 23 and {r.omitted for r in product} == {16}  # dropped after the limit
    cli = lookup.lookup(ask(spark, "k"), postings, entries, dialect="cli").collect()
    assert len(cli) == 8 and "e008" in {r.entry_id for r in cli}  # only found entries count


def test_forms_and_statuses(spark):
    postings, entries = tables(spark, [("study", "s", None, "headword", "study", "study", 0)], [("s", "study", "word", None)])
    forms = index.with_head_keys(spark.createDataFrame([("studies", "s", "study")], "norm string, entry_id string, headword string"))
    queries = ask(spark, "studies", "zzz", "<b>", "STUDY")
    got = lookup.lookup(queries, postings, entries, forms)
    assert {(r.qid, r.match) for r in got.collect()} == {(0, "inflection"), (3, "headword")}
    assert {r.qid: r.status for r in lookup.statuses(queries, got).collect()} == {0: "ok", 1: "not-found", 2: "invalid", 3: "ok"}
    assert {r.status for r in lookup.statuses(queries, got.limit(0), has_pack=False).collect()} == {"no-dictionary", "invalid"}


def test_same_answer_under_other_partitioning(spark):
    rows = [(f"k{i % 3}", f"e{i % 17}", f"s{i}", "phrase" if i % 2 else "alias", f"h{i % 5}", "k", i) for i in range(200)]
    postings, entries = tables(spark, rows, [(f"e{i}", f"h{i}", "word", None) for i in range(17)])
    first = sorted(map(str, lookup.lookup(ask(spark, "k0", "k1"), postings, entries).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, lookup.lookup(ask(spark, "k0", "k1"), postings.repartition(5), entries.repartition(3)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nested_round_trip_and_merge(spark):
    rows = [("a", "e1", None, "headword", "A", "a", 1), ("a", "e2", "s", "phrase", "B", "a", 0), ("b", "e1", None, "alias", "A", "b", 2), ("b", "e1", None, "alias", "A", "b", 5)]
    nested = index.nested(index.distinct_postings(spark.createDataFrame(rows, POSTING)))
    assert {r.norm: [m.entry_id for m in r.matches] for r in nested.collect()} == {"a": ["e2", "e1"], "b": ["e1"]}
    assert index.unnested(nested).count() == 3
    entries = spark.createDataFrame([("x", 1, ["k1"], False, "word", "first"), ("x", 2, ["k2", "k1"], False, "word", "second"), ("x", 3, ["k3"], True, "word", "third"), ("x", 4, ["k4"], True, "derived", "4")], "id string, ord long, source_keys array<string>, locator boolean, kind string, body string")
    row = index.merge_entries(entries, ["body"]).first()
    assert (row.body, row.source_keys) == ("first", ["k1", "k2", "k4"])
    letters = spark.createDataFrame([("apple", 1), ("Axe", 2), ("art", 3), ("ant", 4), ("9", 5)], "k string, o int")
    assert {r.k for r in index.first_per_bucket(letters, index.letter_bucket(F.col("k")), ["o"]).collect()} == {"apple", "Axe", "art", "9"}
