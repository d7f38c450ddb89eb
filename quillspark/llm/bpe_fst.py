"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

A token sequence is the BPE encoding of its bytes if and only if every adjacent
pair of tokens is the encoding of its own bytes. Compiling the merges therefore
needs only a trie of the tokens and a (memoised) test of pairs. The
nondeterministic transducer guesses token ends while it walks the trie; it is
determinised as weighted transducers are: a state is a set of hypotheses (trie
node, last token, tokens not yet emitted), and what all hypotheses of a state
hold in common is emitted on the transition into it. A token is so emitted as
soon as no other segmentation can survive, which takes at most the bytes of the
longest token. States and transitions come into being when a text first needs them.

Text is cut before every run of white space that follows other characters; the
pattern's matches never cross such a cut, so chunks are independent and their
ids are kept in a bounded cache of the worker.

Defined results: null text is empty: no ids, and the digests are those of the
empty string. doc_id may be null and may repeat (rows are mapped one by one). An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import claim, no_text

#: Fixed value: Unicode's White_Space characters, which the pattern's \s means.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bounds of what a worker keeps: chunks in each of two generations, transducer states, length of a kept chunk.
#: A worker then takes up to about 400 MB; jobs with less room pass smaller bounds.
CACHE_CHUNKS, MOST_STATES, CACHE_LENGTH = 300_000, 300_000, 48

ROOT, NEVER = 0, 1 << 40
Hypothesis = tuple[int, int, tuple[int, ...]]


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Bytes of one pre-token in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.tokens = [b""] * (max(ranks.values()) + 1)
        child: dict[int, int] = {}
        self.token_at, self.inner = array("i", [-1]), bytearray(1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                below = child.get(key)
                if below is None:
                    below = child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = below
            self.token_at[node] = rank
        self.child = child
        self.fits: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.reset()

    def reset(self) -> None:
        """Forgets all states. A state is kept packed: node, last token + 1, number of pending tokens, these, for each hypothesis."""
        start = array("I", [ROOT, 0, 0]).tobytes()
        self.states = {start: 0}
        self.packed = [start]
        self.outputs: list[bytes] = [b""]  # in decimal, a blank before each id
        self.output_ids: dict[tuple[int, ...], int] = {(): 0}
        self.rest = array("I", [0])  # output of each state at the end of the input
        self.step: dict[int, int] = {}  # state and byte to next state and output
        self.fits.clear()

    def output_id(self, tokens: tuple[int, ...]) -> int:
        found = self.output_ids.get(tokens)
        if found is None:
            found = self.output_ids[tokens] = len(self.outputs)
            self.outputs.append(b"".join([b" %d" % t for t in tokens]))
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; None for a byte, and for a token no merges lead to."""
        if token not in self.made:
            data, self.made[token] = self.tokens[token], None
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                self.made[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return self.made[token]

    def spine(self, token: int, side: int) -> list[int]:
        """From a byte up to the token: the tokens that stand at its right (side 1) or left (0) edge while it is merged."""
        found = self.spines[side].get(token)
        if found is None:
            found = [token]
            while (parts := self.halves(found[-1])) is not None:
                found.append(parts[side])
            found.reverse()
            self.spines[side][token] = found
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens next to each other stay as they are (left -1: right alone).

        The edges facing each other grow along their spines in the order of ranks; the border
        falls if at some time the pair across it ranks before the next merge on either side
        (of equal ranks the leftmost merge comes first).
        """
        key = (left + 1) << 32 | right
        found = self.fits.get(key)
        if found is not None:
            return found
        if left < 0:
            good = len(self.tokens[right]) == 1 or self.halves(right) is not None
        else:
            a, b, i, j, good = self.spine(left, 1), self.spine(right, 0), 0, 0, True
            while True:
                across = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], NEVER)
                next_a = a[i + 1] if i + 1 < len(a) else NEVER
                next_b = b[j + 1] if j + 1 < len(b) else NEVER
                if across < next_a and across <= next_b:
                    good = False
                    break
                if next_a == next_b == NEVER:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
        self.fits[key] = good
        return good

    def advance(self, state: int, byte: int) -> int:
        """Determinises one transition: the next state, and above it the output of tokens that are now certain."""
        data, at = array("I", self.packed[state]), 0
        alive: list[Hypothesis] = []
        ended: Hypothesis | None = None
        while at < len(data):
            node, last, n = data[at], data[at + 1] - 1, data[at + 2]
            at += 3 + n
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            pending = tuple(data[at - n : at])
            token = self.token_at[below]
            if token >= 0 and ended is None and self.fit(last, token) and (last >= 0 or self.fit(-1, token)):
                ended = (ROOT, token, (*pending, token))
            if self.inner[below]:
                alive.append((below, last, pending))
        if ended is None:
            raise ValueError("the vocabulary has no token for a byte")
        alive.append(ended)
        shared = 0
        least = min(len(x[2]) for x in alive)
        while shared < least and len({x[2][shared] for x in alive}) == 1:
            shared += 1
        flat: list[int] = []
        for node, last, pending in alive:  # in the order of their starts, which is one order a state
            flat += [node, last + 1, len(pending) - shared, *pending[shared:]]
        key = array("I", flat).tobytes()
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = len(self.packed)
            self.packed.append(key)
            self.rest.append(self.output_id(ended[2][shared:]))
        found = self.step[state << 8 | byte] = self.output_id(ended[2][:shared]) << 32 | following
        return found

    def decimal(self, data: bytes) -> bytes:
        """Ids of a pre-token in decimal, a blank before each."""
        if (whole := self.ranks.get(data)) is not None:
            return b" %d" % whole
        if len(self.packed) > self.most_states:
            self.reset()
        state, out, step, outputs = 0, [], self.step, self.outputs
        for byte in data:
            try:
                found = step[state << 8 | byte]
            except KeyError:
                found = self.advance(state, byte)
            state = found & 0xFFFFFFFF
            if found >> 32:
                out.append(outputs[found >> 32])
        out.append(outputs[self.rest[state]])
        return b"".join(out)

    def encode(self, data: bytes) -> list[int]:
        """Ids of a pre-token."""
        return [*map(int, self.decimal(data).split())]


class StreamDecoder:
    """Token bytes in, text out: an incremental UTF-8 machine that holds back an unfinished character.

    Malformed input becomes U+FFFD, as Python's "replace" has it.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the unfinished character that the data ends in: the state between two blocks."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:  # a continuation: look for its lead byte
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def chunks(text: str) -> list[str]:
    """The text cut before every run of white space that follows other characters."""
    return CHUNK.findall(text)


class Codec(dict[str, bytes]):
    """Texts to ids and back, with the caches of one worker process: chunk to its ids in decimal, joined by blanks."""

    def __init__(self, data: bytes, pattern: str, most_chunks: int = CACHE_CHUNKS, most_states: int = MOST_STATES):
        import regex

        self.most_chunks = most_chunks
        self.transducer = Transducer(load_ranks(data), most_states)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.old: dict[str, bytes] = {}
        self.marks = {mark: b" %d" % self.transducer.ranks[mark.encode()] for mark in ".,"}
        self.bytes_of = {b"%d" % rank: token for token, rank in self.transducer.ranks.items()}

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            plain = chunk[0] == " "
            if plain and chunk[-1] in ".," and chunk[1:-1].isalpha():
                return self[chunk[:-1]] + self.marks[chunk[-1]]  # a word and a mark match apart; the word is what is kept
            if plain and chunk[1:].isalpha():
                out = self.transducer.decimal(chunk.encode())
            else:
                out = b"".join([self.transducer.decimal(match[0].encode()) for match in self.pattern.finditer(chunk)])
            out = out[1:]
        if len(chunk) <= CACHE_LENGTH:
            self[chunk] = out
        return out

    def encode_decimal(self, text: str) -> bytes:
        """Ids of the text in decimal, joined by single spaces."""
        if len(self) > self.most_chunks:
            self.old = dict(self)
            self.clear()
        return b" ".join(map(self.__getitem__, chunks(text)))

    def decode_stream(self, ids: Iterable[bytes], block: int = 4096) -> Iterator[str]:
        """Text, piece by piece, of ids in decimal."""
        decoder, held = StreamDecoder(), []
        for i in ids:
            held.append(i)
            if len(held) == block:
                yield decoder.feed(b"".join(map(self.bytes_of.__getitem__, held)))
                held = []
        yield decoder.feed(b"".join(map(self.bytes_of.__getitem__, held))) + decoder.close()


_worker: dict[tuple, Codec] = {}


def _codec(data: bytes, *settings) -> Codec:
    claim("bpe_fst", _worker.clear)
    key = hash(data), settings
    if key not in _worker:
        _worker.clear()
        _worker[key] = Codec(data, *settings)
    return _worker[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = (), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", most_chunks: int = CACHE_CHUNKS, most_states: int = MOST_STATES) -> DataFrame:
    """doc_id, the columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Columns of ``keep`` must not be named like one of the others.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)  # one file of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern, most_chunks, most_states)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, digests, decoded, lists = [], [], [], []
                for text in part.column(1):
                    written = codec.encode_decimal(text.as_py())
                    ids = written.split()
                    sums = hashlib.sha256()
                    for piece in codec.decode_stream(ids):
                        sums.update(piece.encode())
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(written).hexdigest())
                    decoded.append(sums.hexdigest())
                    if with_ids:
                        lists.append([*map(int, ids)])
                made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    made.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                kept = [part.column(0), *(part.column(i + 2) for i in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(kept + made, ["doc_id", *keep, *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_text(text_col).alias("__text"), *keep)
    types = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    return rows.mapInArrow(run, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ids of the public byte-level vocabulary and back."""
    import public_tokenizers

    from quillspark.sources.tables import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
