"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

Fingerprints: lower-cased A-Z, words, 3-word shingles with repeats, XXH64 with
seed 42; a bit is set if it is set in over half the shingle hashes.

Links are all pairs of distinct fingerprints within ``budget`` differing bits.
The trie is walked as pairs of nodes: a pair of nodes spawns the pairs of their
children, the differing bits add up, and a pair is pruned when they exceed the
budget. To spread the walk, the bits are put into ``budget + 1`` orders, each
with another quarter of the bits first: two fingerprints within the budget
agree on one quarter, so in that order they share the whole path down to it
and only pairs of equal nodes need following there. The node under such a path is a
unit of work. A unit with many fingerprints is cut further in the same way:
its remaining bits are quartered again and each fingerprint joins four smaller
units. Four cuts leave 21 free bits, so a unit never exceeds about two million
fingerprints of 8 bytes, whatever the data.

Copies cost nothing: the trie holds distinct fingerprints, each standing for
its least doc_id. Components come from the links by star contraction (components.py).

Defined results: null or wordless text has fingerprint zero and is linked like any other;
a text of one or two words is one shingle. A row with a null doc_id gets its fingerprint, and the
component of that fingerprint (null if no row of it has an id). Repeated rows fall
together. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, claim, join_small, no_text, row_id
from quillspark.llm.components import components

#: Fixed values of the fingerprint.
SEED, SHINGLE, BITS = 42, 3, 64
BUDGET = 3
#: Fingerprints above which a unit of the trie is cut into smaller ones.
UNIT = 20_000
#: No further cut once so few bits are free: a unit then has at most 2**21 fingerprints.
LEAST_FREE = 21
#: Shingle hashes whose bits are counted at once, node pairs walked at once, links held at once, rows held at once (or one unit).
BLOCK, FRONTIER, LINKS, HELD = 65_536, 50_000, 1_000_000, 200_000


def shingle_hashes(text: str) -> np.ndarray:
    """Unsigned XXH64 of all shingles of a text."""
    import xxhash

    found = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII spaces split
    if not found:
        return np.zeros(0, np.uint64)
    n = len(found) - SHINGLE + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = map(b"%b %b %b".__mod__, zip(found, found[1:], found[2:], strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def fingerprint(text: str) -> int:
    hashes = shingle_hashes(text)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("simhash", lambda: None)
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], ["row_id", "doc_id", "mark"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_id (``row_col`` of a written table, else numbers of this scan), doc_id, mark: the fingerprint as a signed long."""
    number = F.col(row_col) if row_col else row_id()
    rows = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), no_text(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "row_id long, doc_id long, mark long")


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x and y pairwise; label names the root, and least member, of each place."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def walk(keys: np.ndarray, marks: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (indexes into the given order) that connects what is within ``budget`` bits inside each unit.

    keys name the unit, marks are its fingerprints with the agreeing bits in front. Node pairs are kept as index ranges over
    the sorted marks and walked depth first in blocks of FRONTIER. Links go into a union-find as
    soon as LINKS of them are there, so memory is bounded by the fingerprints, not by their links. The
    budget grows from 1 bit on: a pair of nodes whose fingerprints are all in one component already is not followed, which
    leaves little to do in dense units. A pair so near its leaves that all below are within the budget is linked as a star.
    """
    order = np.lexsort((marks, keys))
    k, m = keys[order], marks[order]
    n = len(k)
    label = np.arange(n, dtype=np.int32)
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if n else np.zeros(1, np.int64)
    lo, hi = edge[:-1].astype(np.int32), edge[1:].astype(np.int32)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    for allowed in range(1, budget + 1):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        steady = steadiness(label)
        n_held = 0
        stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), np.zeros(len(lo), np.int8))]
        while stack:
            block = stack.pop()
            if len(block[0]) > FRONTIER:
                half = len(block[0]) // 2
                stack += [tuple(x[:half] for x in block), tuple(x[half:] for x in block)]
                continue
            a0, a1, b0, b1, off, at = block
            one = (label[a0] == label[b0]) & (steady[a0] == steady[a1 - 1]) & (steady[b0] == steady[b1 - 1])
            a0, a1, b0, b1, off, at = (x[~one] for x in block)
            # all below are within the budget: every member to the first of the first node
            near = off.astype(np.int16) + (BITS - at.astype(np.int16)) <= allowed
            single = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
            done = near | single
            if done.any():
                x0, x1, y0, y1 = a0[done], a1[done], b0[done], b1[done]
                plain = single[done] & ~near[done]
                far = np.zeros(len(x0), bool)
                far[plain] = np.bitwise_count(m[x0[plain]] ^ m[y0[plain]]) > allowed
                x0, x1, y0, y1 = x0[~far], x1[~far], y0[~far], y1[~far]
                for from_, to in ((x0, x1), (y0, y1)):
                    size = to - from_
                    held.append((np.repeat(x0, size), (np.repeat(from_ - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())).astype(np.int32)))
                    n_held += int(size.sum())
                if n_held > LINKS:
                    unite(label, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, n_held, steady = [], 0, steadiness(label)
            a0, a1, b0, b1, off, at = (x[~done] for x in (a0, a1, b0, b1, off, at))
            if not len(a0):
                continue
            am, bm = _split(m, a0, a1, at), _split(m, b0, b1, at)
            cross = ~((a0 == b0) & (a1 == b1))
            out = [(a0, am, b0, bm, off, at), (am, a1, bm, b1, off, at), (a0, am, bm, b1, off + np.int8(1), at)]
            out.append(tuple(x[cross] for x in (am, a1, b0, bm, off + np.int8(1), at)))
            joined = [np.concatenate(x) for x in zip(*out, strict=True)]
            alone = (joined[0] == joined[2]) & (joined[1] - joined[0] <= 1)
            live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= allowed) & ~alone
            joined = [x[live] for x in joined]
            joined[5] = joined[5] + np.int8(1)
            if len(joined[0]):
                stack.append(tuple(joined))
        if held:
            unite(label, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    child = np.flatnonzero(label != np.arange(n))
    return order[child], order[label[child]]


def steadiness(label: np.ndarray) -> np.ndarray:
    """How often the label has changed up to each place: equal at both ends of a range that has one label throughout."""
    return np.r_[0, np.cumsum(label[1:] != label[:-1])].astype(np.int32) if len(label) else np.zeros(0, np.int32)


def _split(m: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each node [lo, hi) of the sorted marks, where its one-child begins: a binary search on the bit at ``depth``."""
    shift = (BITS - 1 - depth.astype(np.int16)).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = lo + (hi - lo) // 2
        one = (m[np.minimum(mid, len(m) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _turned(mark: Column, free: int, by: int) -> Column:
    """The low ``free`` bits of a mark rotated left by ``by``; the bits above them stay."""
    if not by:
        return mark
    if free == BITS:
        return F.shiftleft(mark, by).bitwiseOR(F.shiftrightunsigned(mark, BITS - by))
    mask = (1 << free) - 1
    low = mark.bitwiseAND(F.lit(mask))
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, free - by)).bitwiseAND(F.lit(mask))
    return mark.bitwiseAND(F.lit(~mask)).bitwiseOR(turned)


def units(marks: DataFrame, scratch: Scratch, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """(key, mark, bits): each fingerprint in its units of work; bits is the mark with the agreeing bits in front."""
    pending = marks.select("mark", F.col("mark").alias("bits"), F.lit(0).cast("long").alias("key"))
    done: DataFrame | None = None
    free = BITS
    while True:
        width = free // (budget + 1)
        spots = []
        for part in range(budget + 1):
            moved = _turned(F.col("bits"), free, part * width)
            front = F.shiftrightunsigned(moved, free - width)
            spots.append(F.struct(F.xxhash64("key", F.lit(part), front).alias("key"), moved.alias("bits")))
        spread = pending.select("mark", F.explode(F.array(*spots)).alias("s")).select("mark", "s.key", "s.bits")
        free -= width
        hot = scratch.save(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > unit).select("key"), "hot")
        n_hot = 0 if free <= LEAST_FREE else hot.count()
        if n_hot:
            pending = join_small(spread, hot, ["key"], "left_semi", rows=n_hot)
            spread = join_small(spread, hot, ["key"], "left_anti", rows=n_hot)
        done = spread if done is None else done.unionByName(spread)
        if not n_hot:
            return done.select("key", "mark", "bits")


def _joined(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Walks whole units as they come, sorted by key; of the rows only unfinished units are held."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def done(part: list[np.ndarray]) -> pa.RecordBatch:
        key, mark, bits = part
        a, b = walk(key, bits.view(np.uint64), budget)
        return pa.RecordBatch.from_arrays([pa.array(mark[a], pa.int64()), pa.array(mark[b], pa.int64())], ["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        rows += batch.num_rows
        if rows >= HELD:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield done([x[:cut] for x in whole])
            held = [[x[cut:] for x in whole]]
            rows = len(held[0][0])
    if rows:
        yield done([np.concatenate(x) for x in zip(*held, strict=True)])


def links(marks: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``budget`` bits; marks has the column mark.

    The links of a batch of units are passed on as a forest: fewer rows, same components.
    """
    work = units(marks, Scratch(marks.sparkSession), budget, unit)
    dealt = work.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _joined(batches, budget), "a long, b long")


def near_groups(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, mark, component_id (least doc_id reachable), group (a mark that names the group)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, id_col, text_col, row_col), "marks")
    reps = scratch.save(rows.groupBy("mark").agg(F.min("doc_id").alias("least")), "reps")
    edges = scratch.save(links(reps.select("mark"), budget), "links")
    found = scratch.save(components(edges), "components")
    named = found.join(reps, F.col("node") == F.col("mark")).select("node", "component", "least")
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(low, "component").select(F.col("node").alias("mark"), F.col("component").alias("group"), "component_id")
    whole = reps.join(named, "mark", "left").select("mark", F.coalesce("group", "mark").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    whole = scratch.save(whole, "groups")
    scratch.drop(reps, edges, found)
    return rows.join(whole, "mark").select("row_id", "doc_id", "mark", "component_id", "group")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    from quillspark.sources.tables import table

    rows = near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
