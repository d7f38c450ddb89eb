"""Exact dedup, mixing, BPE and ORC tokens against plain Python."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest_llm import EDGES

from quillspark.llm import bpe_fst, exact_dedup, mixing, orc_tokens
from quillspark.llm.common import Scratch, scratch_path
from quillspark.sources.tables import table


def plain_dedup(rows):
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups[hashlib.sha256("".join(c for c in text if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()].append((-len(text), doc_id, at))
    out = []
    for digest, members in groups.items():
        members.sort()
        for n, (_, doc_id, _) in enumerate(members):
            out.append((doc_id, members[0][1], len(members), n == 0, digest))
    return sorted(out)


def test_exact_dedup_matches_plain(spark, make):
    docs = make(EDGES + EDGES[3:6])
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=4)
    got = exact_dedup.dedup(docs, index).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == plain_dedup([(r.doc_id, r.text) for r in docs.collect()])


def test_digest_index_persists_and_rejects_known(spark, make):
    path = scratch_path(spark, "index")
    first = exact_dedup.dedup(make(["alpha beta", "gamma"]), exact_dedup.DigestIndex(spark, path, buckets=4)).collect()
    assert all(r.kept for r in first)
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    index.drop()  # the catalog forgets the table; the files stay
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    second = {r.doc_id: r for r in exact_dedup.dedup(make([(7, "alphabeta", "en", "s"), (8, "delta", "en", "s")]), again).collect()}
    assert second[7].known and not second[7].kept and second[7].keep_id == 0
    assert second[8].kept and not second[8].known
    assert again.table().count() == 3


def test_digest_index_counts_all_batches(spark, make):
    path = scratch_path(spark, "index")
    sizes = []
    for texts in (["a b", "ab "], ["ab", "a b", " ab", "new"], ["ab", "new", "new "], [(None, "a\nb", "en", "s")]):
        index = exact_dedup.DigestIndex(spark, path, buckets=4)
        got = {r.text_sha256: (r.group_size, r.known, r.keep_id) for r in exact_dedup.dedup(make(texts), index).collect()}
        sizes.append(got[hashlib.sha256(b"ab").hexdigest()])
    assert sizes == [(2, False, 0), (5, True, 0), (6, True, 0), (7, True, 0)]
    assert sorted(r.group_size for r in index.table().collect()) == [3, 7]


def test_a_batch_can_be_run_again(spark, make):
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    key = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in rows)
    exact_dedup.dedup(make(["a b", "c"]), index, batch="one").collect()
    docs = make([(5, "ab", "en", "s"), (6, "new", "en", "s"), (7, "ne w", "en", "s")])
    first = key(exact_dedup.dedup(docs, index, batch="two").collect())
    exact_dedup.dedup(docs, index, batch="two")  # its caller dies before the result is written
    assert key(exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path, buckets=4), batch="two").collect()) == first
    assert first == [(5, 0, 2, False, True), (6, 7, 2, False, False), (7, 7, 2, True, False)]


def test_compaction_keeps_every_digest(spark, make):
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=2)
    for at in range(3):
        exact_dedup.dedup(make(["same", f"text {at}"]), index).collect()
    before = sorted((bytes(r.digest), r.keep_id, r.group_size) for r in index.table().collect())
    index.compact(per_bucket=1)
    assert index.buckets == 4
    for again in (index, exact_dedup.DigestIndex(spark, path)):  # reopened: the generation and its buckets are read from the folder
        assert again.buckets == 4 and sorted((bytes(r.digest), r.keep_id, r.group_size) for r in again.table().collect()) == before
        assert len(again.rows().inputFiles()) <= 4
    got = {r.doc_id: r for r in exact_dedup.dedup(make([(9, "sa me", "en", "s"), (10, "fresh", "en", "s")]), index).collect()}
    assert got[9].known and got[9].group_size == 4 and got[10].kept


def test_exact_query_takes_two_batches(spark, sf):
    got = exact_dedup.op4_exact_dedup(spark, sf).collect()
    want = plain_dedup([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    even = {r.text_sha256 for r in got if r.doc_id % 2 == 0}
    assert all(r.known == (r.doc_id % 2 == 1 and r.text_sha256 in even) for r in got) and any(r.known for r in got)


def test_exact_dedup_ties_nulls_and_empty(spark, make):
    docs = make([(None, "x y", "en", None), (3, "xy ", "en", None), (3, "xy ", "en", None), (2, "xy", "en", None)])
    got = exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=2)).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {3} and {r.group_size for r in got} == {4}
    assert exact_dedup.dedup(docs.limit(0), exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=2)).count() == 0


def test_survivors_keep_their_columns(spark, make):
    docs = make(["a b", "ab ", "c", None, ""])
    kept = exact_dedup.survivors(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=2))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def plain_targets(size_of, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(size_of.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * size_of[s]}
        if not over:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(cap * size_of[s])
        left -= sum(cap * size_of[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_targets(spark, sf, make):
    for docs in (table(spark, sf, "documents"), make([(i, "w " * (i % 37 + 1), "en", f"s{i % 5}" if i % 7 else None) for i in range(400)])):
        rows = mixing.mix(docs).collect()
        size_of, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
        for r in rows:
            size_of[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            largest[r.source] = max(largest[r.source], r.size)
            assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        want = plain_targets(size_of)
        for s in want:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - want[s]) <= 1.5 * largest[s]


def plain_rates(sizes, target, cap=3):
    """Rates min(cap, exp(m * size)) that sum to the target, by bisection."""
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(n * min(cap, math.exp(min(20, mid * n))) for n in sizes) < target:
            low = mid
        else:
            high = mid
    return {n: min(cap, math.exp(min(20, high * n))) for n in sizes if n}


def test_mix_tilts_documents_by_size(spark, sf, make):
    for docs in (table(spark, sf, "documents"), make([(i, "w " * (i * i % 91), "en", f"s{i % 4}" if i % 9 else None) for i in range(500)])):
        rows = mixing.mix(docs).collect()
        of = defaultdict(list)
        for r in rows:
            of[r.source].append(r)
        varied = 0
        for found in of.values():
            want, got = plain_rates([r.size for r in found], found[0].target), {r.size: r.rate_millionths / 1e6 for r in found if r.size}
            assert got == pytest.approx(want, abs=2e-6)
            varied += len(set(got.values())) > 1
        assert varied >= len(of) / 2  # the rates differ inside a source


def test_mix_hot_and_odd_ids(spark, make):
    rows = [(None, "w " * 5, "en", "a")] * 300 + [(64 * i, "w " * 5, "en", "a") for i in range(300)] + [(7, "w " * 9, "en", "b")] * 40 + [(1, "v " * 30_000, "en", "b")]
    first, again = ([(r.doc_id, r.source, r.size, r.copies) for r in mixing.mix(make(rows)).collect()] for _ in range(2))
    assert len(first) == 641 and sorted(map(str, first)) == sorted(map(str, again))
    lanes = mixing.mix(make(rows)).where("doc_id IS NULL AND copies > 0").count()
    assert 0 < lanes <= 300


def test_mix_reports_a_dual_that_does_not_settle(spark):
    histogram = spark.createDataFrame([(1, 5, 10), (1, 9, 4)], "sid long, size long, n long")
    aims = spark.createDataFrame([(1, 70.0, False)], "sid long, target double, capped boolean")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.solve_dual(histogram, aims, Scratch(spark), most=1)


def test_mix_caps_and_edges(spark, make):
    docs = make([(0, "w " * 10, "en", "a"), (1, "w " * 990, "en", "b"), (2, None, "en", "c"), (None, "w", "en", None), (2, "", "en", "b")])
    rows = {(r.doc_id, r.source): r for r in mixing.mix(docs).collect()}
    assert rows[0, "a"].target == pytest.approx(30.0) and rows[0, "a"].copies == 3
    assert rows[2, "c"].target == 0 and rows[2, "c"].taken == 0 and len(rows) == 5
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(make([None, ""])).collect())


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe_fst.Codec(file.read(), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


ODD = ["", " ", "  a", "a  b\n\n c\t\td ", "\x1c\x1d!\x1c a", "don't we'll I'VE", "日本語 テスト", "\U0001f600\U0001f600 x", "é   x  y", "x" * 5000, "ab" * 999 + " 12345678901234567890 ²½Ⅷ", "<|endoftext|> a", "<|endoftext|> hello <|endoftext|>", "x<|startoftext|>y<|endoftext|><|endoftext|", "<|EndOfText|>", "aaaa   \n", "﻿a​ b", "ñandú Über ßtraße"]


def test_transducer_equals_library(codec, reference, spark, sf):
    texts = ODD + [r.text for r in table(spark, sf, "documents").collect()]
    for text in texts:
        written = codec.encode_decimal(text)
        assert [*map(int, written.split())] == reference.encode_ordinary(text), text[:80]
        assert "".join(codec.decode_stream(written.split(), block=3)) == text


def test_transducer_on_random_bytes(codec, reference):
    rng = np.random.default_rng(7)
    alphabet = "abcdeéxyzß日'1 \n!-"
    for _ in range(400):
        text = "".join(rng.choice([*alphabet], rng.integers(1, 60)))
        assert [*map(int, codec.encode_decimal(text).split())] == reference.encode_ordinary(text)


def test_transducer_emits_after_bounded_lookahead(codec):
    machine, longest = codec.transducer, max(map(len, codec.transducer.tokens))
    state = out = 0
    for n, byte in enumerate(b"internationalization" * 20, 1):
        found = machine.step.get(state << 8 | byte) or machine.advance(state, byte)
        state, tokens = found & 0xFFFFFFFF, machine.outputs[found >> 32]
        out += sum(len(machine.tokens[int(t)]) for t in tokens.split())
        assert n - out <= 2 * longest


def test_stream_decoder_splits_anywhere():
    data = "aé日\U0001f600ß".encode()
    for cut in range(len(data) + 1):
        decoder = bpe_fst.StreamDecoder()
        assert decoder.feed(data[:cut]) + decoder.feed(data[cut:]) + decoder.close() == data.decode()
    broken = bpe_fst.StreamDecoder()
    assert broken.feed(b"a\xe6\x97") + broken.close() == "a�"


def test_bpe_documents_edges(spark, make, reference):
    docs = make(EDGES)
    got = {r.doc_id: r for r in bpe_fst.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=("source",), with_ids=True).collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_orc_tokens_equal_library(spark, make, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for docs in (make(EDGES + ODD + [(3, "one", "en", "s"), (None, "last", "en", "s")]), table(spark, sf, "documents")):
        path = scratch_path(spark, "tokens")
        orc_tokens.write_tokens(docs, path, P.path("word_bpe_49k.json"))
        got = sorted(orc_tokens.digest_tokens(orc_tokens.read_tokens(spark, path)).collect(), key=lambda r: r.start)
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
        assert len(got) == len(rows)
        start = 0
        for r, g in zip(rows, got, strict=True):
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
            assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
            assert g.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
            start += len(ids)


def test_orc_prunes_by_doc_id(spark, make):
    path = scratch_path(spark, "tokens")
    orc_tokens.write_tokens(make(["a b", "c"]), path, P.path("word_bpe_49k.json"))
    one = spark.read.orc(path).where("doc_id = 1")
    assert [r.doc_id for r in one.collect()] == [1]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in one._jdf.queryExecution().toString()
    orc_tokens.write_tokens(make([]), empty := scratch_path(spark, "tokens"), P.path("word_bpe_49k.json"))
    assert orc_tokens.read_tokens(spark, empty).count() == 0


def test_orc_files_hold_stripes_row_index_and_bloom_filters(spark, make):
    """Read back from the files themselves: several stripes, each with run-length encoded ids, a row index and a Bloom filter of doc_id."""
    path = scratch_path(spark, "tokens")
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 120), i -> substr(sha2(concat(id, ':', i), 256), 1, 6))) AS text").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")
    try:
        orc_tokens.write_tokens(docs, path, P.path("word_bpe_49k.json"), stripe=4 << 20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    jvm, files = spark._jvm, spark.read.orc(path).inputFiles()
    conf = spark._jsc.hadoopConfiguration()
    stripes, column = 0, None
    for name in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        column = reader.getSchema().findSubtype("doc_id").getId()
        n = reader.getStripes().size()
        stripes = max(stripes, n)
        inner = reader.rows()
        for i in range(n):
            footer = inner.readStripeFooter(reader.getStripes().get(i))
            kinds = {(st.getKind().toString(), st.getColumn()) for st in footer.getStreamsList()}
            assert ("ROW_INDEX", column) in kinds and ("BLOOM_FILTER_UTF8", column) in kinds
            assert footer.getColumns(column).getKind().toString() == "DIRECT_V2"  # integer run-length encoding, second version
        inner.close()
    assert stripes > 1


def test_word_encoder_equals_library_on_random_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encode = orc_tokens.WordEncoder(file.read()).encode
    rng = np.random.default_rng(11)
    alphabet = [*"abcdeéÉxyzßẞ日'1²½Ⅷ٣ \n!-_.,", "\x1c", "\x85", " ", "́", "Σ", "ς", "İ", "K", "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "'s", "'LL", "​", "\U0001d400", "ǅ", "ª", "ー", "ा"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
