"""Quality rules against DuckDB, the rule ensemble against numpy and held-out labels."""

import zlib

import duckdb
import numpy as np
from conftest_llm import EDGES

from quillspark.llm import quality_model as M
from quillspark.llm import quality_rules as R
from quillspark.llm.common import Scratch
from quillspark.sources.tables import table


def rules_by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    return con.sql(R.ORACLE).fetchall()


def test_rules_equal_sql_on_edges(spark, make):
    loop = "a b c d e f g h i"
    docs = make([*EDGES, *[(100 + i, f"word{i} " * 3 + loop + f" tail{i % 3} {loop if i % 4 else ''} ###" * (i % 5), None if i % 3 else "de", f"s{i % 2}") for i in range(120)], (None, loop * 40, None, None), (5, loop, "en", None)])
    rows = R.judge(R.measures(docs), Scratch(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules").collect()
    want = [(*x[:7], x[7], x[8]) for x in rules_by_sql(docs)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_rules_keep_clean_and_drop_symbols(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = R.judge(R.measures(docs), Scratch(spark)).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("kept", "base_failed", "quality").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) >= 0.99 and np.mean(junk) <= 0.1


def test_sketches_decide_most_fences(spark):
    scratch = Scratch(spark)
    rows = R.measures(table(spark, "/root/testdata/sf0.1", "documents")).select("*", *R.rates())
    fences = [r for r in R.limits_of(R.sketch(rows.where("NOT base_failed")), scratch).collect() if r["size"] >= R.LEAST]
    upper = {m: [r[f"{m}_high"] for r in fences] for m in R.MEASURES}
    least = {m: R.WIDTH * v[0] for m, v in R.MEASURES.items()}
    moved = {m: sum(x != least[m] for x in xs) for m, xs in upper.items()}  # fences above what the least spread alone gives
    assert len(fences) >= 50 and 2 * sum(moved.values()) >= len(fences) * len(R.MEASURES)
    for m in ("echo_rate", "upper_rate", "word_length"):
        assert moved[m] == len(fences) and len(set(upper[m])) >= 5


def test_an_outlier_of_one_source_is_normal_in_another(spark, make):
    plain = "some plain words stand here and there and make up a line of text that nobody minds at all number"
    shout = "SOME loud WORDS stand HERE and THERE and MAKE up a LINE of text THAT nobody MINDS at ALL number"
    rows = [(i, f"{plain} w{i} x{i}", "en", "calm") for i in range(80)] + [(100 + i, f"{shout} w{i} x{i}", "en", "loud") for i in range(80)]
    rows += [(500, f"{shout} w x", "en", "calm"), (501, f"{shout} w x", "en", "loud")]
    kept = {r.doc_id: r.kept for r in R.judge(R.measures(make(rows)), Scratch(spark)).collect()}
    assert not kept[500] and kept[501] and sum(kept.values()) == 161


def test_sketch_error_and_merge(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(0, 10**6, 500)] + [0, 1, 63, 64, 65, 127, 128]
    df = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("v", "v AS x")
    got = df.select("v", R.bucket(df.v).alias("b")).select("v", R.bucket_top(__import__("pyspark").sql.functions.col("b")).alias("top")).collect()
    assert all(r.v <= r.top <= r.v * (1 + 1 / 32) for r in got)


def test_rules_empty(spark, make):
    assert R.judge(R.measures(make([])), Scratch(spark)).count() == 0


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(M.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5) | (x[:, 8] > 0.9)).astype(float)
    model = M.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in M.STATISTICS))
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    want = 1 / (1 + np.exp(-model.numpy_margin(x)))
    assert np.allclose(np.sort(got), np.sort(want)) and len(model.rules) > 0
    assert np.mean((want >= 0.5) == (y == 1)) >= 0.98


def test_statistics_of_a_text(spark, make):
    r = M.statistics(make(["Ab ab ab 12!!\n\nAb ab ab 12!!\nx|y"])).first()
    assert (r.n_words, r.n_lines, r.longest_word) == (9, 3, 4)
    assert r.echo_share == 2 / 9 and r.distinct_share == 4 / 9 and r.symbol_share == 1 / 9 and abs(r.dup_line_share - 1 / 3) < 1e-12


def test_held_out_labels(spark):
    rows = M.op10_quality_model(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.93  # area under the curve; some labels are noise


def test_more_labels_than_the_sample_give_one_model(spark):
    sf = "/root/testdata/sf0.01"
    stats = M.statistics(table(spark, sf, "documents"))
    models = [M.fit(stats.repartition(n), table(spark, sf, "labels").repartition(n), sample=120) for n in (1, 7)]
    assert models[0].rules == models[1].rules and models[0].weights == models[1].weights and models[0].bias == models[1].bias


def test_model_edges(spark, make):
    docs = make([*EDGES, (None, "null id", "en", "s")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    stats = M.statistics(docs)
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = stats.select("doc_id", M.fit(stats, some).score().alias("s")).collect()
        assert len(rows) == len(EDGES) + 1 and all(0 <= r.s <= 1 for r in rows)
    assert M.statistics(make([])).count() == 0
