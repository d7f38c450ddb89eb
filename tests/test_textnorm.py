"""Keys, phrases and small scalar functions: golden cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ocr, phrases
from quillspark.functions import textnorm as N


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


@pytest.mark.parametrize("dialect", ["product", "cli"])
def test_fold_and_keys(spark, dialect):
    texts = ["U.", "run.", "  Someone’s well‑being  ", "ＳＴＵＤＩＥＳ", "Straße", "a↔b", "x​ y", "...", "ΛΌΓΟΣ", None]
    want = [["u.", "u"], ["run.", "run"], ["someone's well-being"], ["studies"], ["strasse"], ["a b"], ["x y"], ["..."], ["λόγοσ"], None]
    got = column(spark, texts, lambda t: N.lookup_keys(N.fold(t, dialect), dialect))
    assert got == want


def test_ascii_path_needs_no_python(spark):
    df = spark.createDataFrame([("A  b.",)], "t string").select(N.fold(F.col("t"), unicode=False).alias("k"))
    assert df.first()[0] == "a b." and "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_valid_query(spark):
    texts = ["run", "a" * 160, "a" * 161, "<script>", "two\nlines", "中文", " ".join(["w"] * 12), " ".join(["w"] * 13), "a" + "😀" * 80, "", None]
    assert column(spark, texts, N.valid_query) == [True, True, False, False, False, False, True, False, False, False, False]


def test_explicit_inflections(spark):
    df = spark.createDataFrame([("run", ["past tense ran", ", running", "run", "past participle run", "not a form!"]), ("make", ["past tense and past participle made"])], "h string, f array<string>")
    assert [r[0] for r in df.select(N.explicit_inflections(F.col("f"), F.col("h"))).collect()] == [["ran", "running"], ["made"]]


def test_phrase_keys():
    assert {"take something into account", "take into account"} <= set(phrases.phrase_keys("take something into account"))
    assert "take account of" in phrases.phrase_keys("take account of something")
    assert phrases.phrase_keys("sb/sth") == ["sb/sth"] or "sb" not in phrases.phrase_keys("sb/sth")
    assert {"give up", "give in", "give up/in"} == set(phrases.phrase_keys("give up/in"))
    assert phrases.phrase_keys("run out / be short of") and phrases.phrase_keys(None) == [] and phrases.phrase_keys("  ") == []
    assert len(phrases.phrase_keys("a/b c/d e/f g/h")) == 1  # sixteen combinations: left as it is


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab /'sth.", max_size=30))
def test_phrase_keys_are_few_distinct_and_loose(text):
    keys = phrases.phrase_keys(text)
    assert len(keys) == len(set(keys)) <= phrases.MOST_KEYS and all(len(k) >= 2 and k == k.casefold().strip() for k in keys)


def test_definitions_versions_labels(spark):
    df = spark.createDataFrame([("", "en"), (None, None), ("zh", "en")], "zh string, en string")
    assert sorted(r[0] for r in df.select(N.definition(F.col("zh"), F.col("en"))).collect()) == ["", "en", "zh"]
    pairs = [("1.2.0", "1.1.9", True), ("1.2", "1.2.0", False), ("v2.0", "1.9", True), ("1.10", "1.9", True), ("x", "1.0", False), ("1.0", "x", False), ("1.0.0.1", "1.0", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r[0] == r.w for r in df.select(N.is_newer(F.col("a"), F.col("b")), "w").collect())
    df = spark.createDataFrame([("an abbreviation of", ["university"]), ("a test", ["full"]), ("a full test", ["full"])], "t string, f array<string>")
    assert [r[0] for r in df.select(N.with_full_forms(F.col("t"), F.col("f"))).collect()] == ["an abbreviation of university", "a test (full)", "a full test"]
    assert column(spark, ["run.", "...", "Café au lait"], lambda t: N.slug(N.loosen(N.fold(t)))) == ["run", "x", "caf-au-lait"]
    assert column(spark, ["n, v / adj", "[C]; U"], N.split_pos) == [["n", "v", "adj"], ["C]; U"]]


def test_scan_keys(spark):
    assert column(spark, ["re•sist", "e-mail,", "bank²", "Don't stop", None], ocr.headword_key) == ["resist", "email", "bank", "dont stop", None]
    assert column(spark, ["husband", "give sb sth (formal)"], ocr.phrase_key) == ["hu and", "give"]
    assert column(spark, ["exam- ple", "中 文 字", "a   b"], ocr.join_hyphenated) == ["example", "中文字", "a b"]
    assert [tuple(r) for r in column(spark, ["tɒm美tɑːm", "英tɒm; tɑːm", "tɒm", ""], ocr.ipa_regions)] == [("tɒm", "tɑːm"), ("tɒm", "tɑːm"), ("tɒm", None), (None, None)]
    assert column(spark, ["ˈtest", "te5t", None, "x", "测试"], ocr.ipa_uncertain) == [False, True, True, True, True]
    assert column(spark, ["bank²", "v2", "2"], lambda t: ocr.homograph(t)["number"]) == [2, 2, None]
