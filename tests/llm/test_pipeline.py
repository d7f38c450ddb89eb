"""The pipeline, stage by stage, against the plain versions of the operators' tests."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as C
import public_tokenizers as P
import pytest
from test_exact_tokens_mix import plain_targets
from test_line_dedup import plain
from test_simhash import plain_groups, plain_mark

from quillspark.llm import bpe_fst, language_id
from quillspark.llm.common import Scratch


CLASHING = ("row_id", "n_lines", "__row", "__rejected")


@pytest.fixture(scope="module")
def steps(spark):
    """The result of every stage over a small table with planted copies."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(70)
    docs = docs.unionByName(docs.limit(6).withColumn("doc_id", docs.doc_id + 1000)).withColumns({"row_id": docs.lang, "n_lines": docs.lang, "__row": docs.lang, "__rejected": docs.lang})
    long = spark.createDataFrame([(2000, "a very long text of common words " * 20_000, "en", "s0", 680_000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(long.selectExpr("*", "lang AS row_id", "lang AS n_lines", "lang AS __row", "lang AS __rejected"))
    out, scratch = [docs], Scratch(spark)
    for name, stage in C.STAGES:
        out.append(scratch.save(stage(spark, out[-1], ""), name))
    return [x.collect() for x in out]


def test_language_stage_keeps_clean_documents(steps, spark):
    before, after = steps[0], steps[1]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert len(after) >= len(before) - 2
    for step in steps[1:5]:  # an extra columns with clashing names come through as they were
        assert all(set(r.asDict()) == {*C.COLUMNS, *CLASHING} and all(r[c] == r.lang for c in CLASHING) for r in step)


def test_line_stage(steps):
    before = sorted(steps[1], key=lambda r: r.doc_id)
    want = {r.doc_id: t for r, (t, _, _) in zip(before, plain([(r.doc_id, r.text) for r in before], 10), strict=True)}
    assert {r.doc_id: r.text for r in steps[2]} == want
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_stage_keeps_the_first_of_each_group(steps):
    marks = {r.doc_id: plain_mark(r.text) for r in steps[2]}
    group = plain_groups(marks.values())
    least = {}
    for d, m in sorted(marks.items()):
        least.setdefault(group[m], d)
    assert sorted(r.doc_id for r in steps[3]) == sorted(least.values())


def test_mix_stage(steps):
    size = {r.doc_id: len(r.text.split()) for r in steps[3]}
    source = {r.doc_id: r.source for r in steps[3]}
    taken, whole, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    copies = Counter(r.doc_id for r in steps[4])
    for d, n in size.items():
        whole[source[d]] += n
        largest[source[d]] = max(largest[source[d]], n)
        taken[source[d]] += n * copies[d]
        assert copies[d] <= 3
    for s, want in plain_targets(whole).items():
        assert abs(taken[s] - want) <= 1.5 * largest[s]


def test_encode_stage(steps):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe_fst.load_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in steps[4]}
    assert Counter(r.doc_id for r in steps[5]) == Counter(r.doc_id for r in steps[4])
    for r in steps[5]:
        assert list(r.ids) == library.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_and_nulls(spark, make):
    docs = make([(None, None, None, None), (None, None, None, None), (1, "", "en", "a")])
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
    assert language_id.fit(make([])).languages == []
