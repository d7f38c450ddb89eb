"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id, encoded, and written with
their token count and their start inside the partition. Partition totals (two
narrow columns of the written files) give every partition's offset, so a
document's position in the whole stream needs no global scan. Readers take any
stripe alone, and prune stripes by the doc_id statistics and Bloom filters.

The vocabulary's added tokens are found in the raw text first, as the library does, and become one
id each. No merge crosses the words that the vocabulary splits the rest into, so the words
are encoded by the tokenizers library and kept in a bounded cache of the worker.

Defined results: null text is empty and has only the end id; null doc_ids come
last (they and repeated ids are dealt by the first letters of their texts too, so many of them do not meet in one task); rows with one doc_id are ordered by text, repeated rows stay side by side; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import claim, no_text, scratch_path

#: Fixed value: the id appended to each document.
END_ID = 2
#: Words and chunks kept in each of the two generations of a worker's cache, and the longest kept (bytes).
CACHE_WORDS, CACHE_LENGTH = 350_000, 48
#: Ids in one Arrow batch sent back to the JVM; letters of a text that help to deal rows of one doc_id.
FLUSH_IDS, PREFIX = 1_000_000, 24
#: Bytes of a stripe.
STRIPE = 64 << 20
#: The vocabulary's own split into words, and Unicode's White_Space, which its \\s means.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+"


class WordEncoder(dict[bytes, bytes]):
    """Texts to ids by way of a bounded cache from a word's UTF-8 to its ids' bytes.

    Added tokens are cut out first. What is between them is normalised and split as the vocabulary file says: NFC, lower case letter by letter,
    PIECE. Chunks between blanks are cached like words. What the young generation lacks is sought in the
    old one, else built of its words; a word goes through the model of the tokenizers library.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model.tokenize
        self.split = regex.compile(PIECE).findall
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = dict(enumerate(byte_letters()))
        added = json.loads(spec).get("added_tokens") or []
        if odd := [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]:
            raise ValueError(f"added tokens with rules of their own are not supported: {odd}")
        self.added = {t["content"]: self.coded[t["id"]] for t in added}
        # of tokens that begin at one place the longest counts
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if added else lambda text: [text]
        self.old: dict[bytes, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word, each of its bytes written as the vocabulary's letter for it."""
        if not word.isascii() or not word.isalpha():
            word = word.encode().decode("latin-1").translate(self.letters)
        coded = self.coded
        return b"".join([coded[token.id] for token in self.model(word)])

    def __missing__(self, key: bytes) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            text = key.decode()
            if text.isalpha():
                ids = self.word(text)
            else:
                words = [text[:-1], text[-1]] if text[-1] in ".," and text[:-1].isalpha() else self.split(text)
                ids = self.word(text) if words == [text] else b"".join([self[w.encode()] for w in words])
        if len(key) <= CACHE_LENGTH:
            self[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers, without the end id."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        parts = self.cut(text)
        return self.piece(text) if len(parts) == 1 else b"".join([self.added[part] if at % 2 else self.piece(part) for at, part in enumerate(parts)])

    def piece(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: Python alone would give a final sigma its own form
        lower = text.replace("\u03a3", "\u03c3").lower()
        return b"".join(map(self.__getitem__, lower.encode().split()))  # at ASCII blanks, which no word crosses


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: its own, or the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_worker: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """The encoder of this worker process."""
    claim("orc_tokens", _worker.clear)
    key = hash(spec)
    if key not in _worker:
        _worker[key] = WordEncoder(spec)
    return _worker[key]


def _encode(batches: Iterator[pa.RecordBatch], spec: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, start, end = TaskContext.get().partitionId(), 0, np.asarray([end_id], "<u4").tobytes()
    ids: list[int | None] = []
    coded: list[bytes] = []
    starts: list[int] = []
    held, encode = 0, encoder(spec).encode

    def flush() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        offsets = np.zeros(len(coded) + 1, np.int32)
        offsets[1:] = np.cumsum(lengths)
        values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts, pa.int64()), pa.array(lengths), lists],
            ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
        )

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc_id in enumerate(doc_ids):
            out = encode(texts[i].as_py()) + end
            ids.append(doc_id)
            coded.append(out)
            starts.append(start)
            start += len(out) // 4
            held += len(out) // 4
            if held >= FLUSH_IDS:
                yield flush()
                ids, coded, starts, held = [], [], [], 0
    if ids:
        yield flush()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", stripe: int = STRIPE) -> None:
    """Encodes every text and writes ORC files at ``path``, in ascending doc_id order."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # one file of a fixed size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode(batches, sent.value, end_id)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_text(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    coded = rows.repartitionByRange(order[0], F.substring("text", 1, PREFIX)).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    coded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(stripe)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents written at ``path``."""
    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a written partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    # a row a partition: bounded by the number of partitions, which Spark itself holds on the driver
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        sums = [zlib.crc32(values[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids as read."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ORC and back."""
    import public_tokenizers

    from quillspark.sources.tables import table

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest_tokens(read_tokens(spark, path))
