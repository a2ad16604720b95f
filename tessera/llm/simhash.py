"""SimHash near-duplicates with a Gray-order hierarchical index.

Copies collapse to one row per distinct fingerprint.  Two fingerprints within d bits agree on at least one
of d + 1 blocks of bits, so each fingerprint goes to one bucket per block (buckets above a size are dealt
again by a block of their remaining bits).  A bucket is indexed: fingerprints sorted by Gray rank are the
leaves; each upper node keeps the bits all its members share and its parent does not already hold.  A query
adds up differences on the way down and leaves a whole group as soon as they exceed d.  Tasks return a
spanning forest of the links they found, and components are joined up across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import arrow_schema, materialize

SHINGLE = 3
MAX_BITS = 2
FAN = 8
#: fingerprints of a bucket above which it is dealt again by its remaining bits
BUCKET_ROWS = 50_000
#: shingles whose bits are unpacked at once
_CHUNK = 1 << 16
#: queries that descend the index together
_QUERIES = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash of word shingles (signed); 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: exactly A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip((end - size)[:len(words) - shingle + 1].tolist(),
                                                              end[shingle - 1:].tolist())]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), _CHUNK):
        part = values[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(ones * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; a null text has no words."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, fp bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), fps], schema=out)

    return slim.mapInArrow(run, schema)


# --------------------------------------------------------------------------- index

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each codeword in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """Hierarchical index over buckets of fingerprints (all buckets of one task side by side)."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.fp, bucket = fp[order], bucket[order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        # levels from the leaves up: (first child, past last child, shared bits, their mask, last leaf)
        leaf = np.arange(len(fp))
        low, high, mask, group, last = self.fp, self.fp, np.full(len(fp), full), bucket, leaf
        levels = [(leaf, leaf + 1, low, mask, last)]
        while True:
            start = np.concatenate([[True], group[1:] != group[:-1]])
            first = np.flatnonzero(start)
            if len(first) == len(group):
                break
            place = np.arange(len(group)) - first[np.cumsum(start) - 1]
            heads = np.flatnonzero(place % FAN == 0)
            tails = np.concatenate([heads[1:], [len(group)]])
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            last, group = last[tails - 1], group[heads]
            levels.append((heads, tails, low, ~(low ^ high), last))
        self.levels = levels
        # a node holds only bits its parent does not: differences add up along the path
        self.own = [levels[-1][3]]
        for above, here in zip(levels[::-1], levels[-2::-1]):
            parent = np.repeat(np.arange(len(above[0])), above[1] - above[0])
            self.own.append(here[3] & ~above[3][parent])
        self.own.reverse()
        self.roots = np.searchsorted(levels[-1][4], leaf)  # each leaf's own bucket

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of leaves in one bucket that differ in at most ``limit`` bits."""
        top = len(self.levels) - 1
        for i in range(0, len(self.fp), _QUERIES):
            query = np.arange(i, min(i + _QUERIES, len(self.fp)))
            pending = [(top, query, self.roots[query], np.zeros(len(query), np.int16))]
            while pending:
                level, query, node, diff = pending.pop()
                if len(query) > 64 * _QUERIES:  # bound the width of the frontier
                    half = len(query) // 2
                    pending += [(level, query[:half], node[:half], diff[:half]), (level, query[half:], node[half:], diff[half:])]
                    continue
                first, past, bits, _, last = self.levels[level]
                diff = diff + _popcount((self.fp[query] ^ bits[node]) & self.own[level][node])
                keep = (diff <= limit) & (last[node] > query)
                query, node, diff = query[keep], node[keep], diff[keep]
                if not len(query):
                    continue
                if level == 0:
                    yield query, node
                    continue
                width = past[node] - first[node]
                child = np.repeat(first[node], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                pending.append((level - 1, np.repeat(query, width), child, np.repeat(diff, width)))


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs, taken in one batch at a time."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jump = label[label]
                if np.array_equal(jump, label):
                    break
                label = jump
    return label


def _bucket_links(limit: int):
    out = arrow_schema("a bigint, b bigint")

    def solve(key: np.ndarray, fp: np.ndarray):
        index = GrayIndex(key, fp.view(np.uint64))
        label = spanning_forest(len(fp), index.links(limit))
        own = np.flatnonzero(label != np.arange(len(label)))
        signed = index.fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[own]), pa.array(signed[label[own]])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by bucket: whole buckets are solved together, the last open one is carried on
        keys, fps, rows = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False).copy())
            fps.append(batch.column(1).to_numpy(zero_copy_only=False).copy())
            rows += len(batch)
            if rows >= 4 * BUCKET_ROWS and keys[-1][-1] != keys[0][0]:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield solve(key[:cut], fp[:cut])
                keys, fps, rows = [key[cut:]], [fp[cut:]], len(key) - cut
        if rows:
            yield solve(np.concatenate(keys), np.concatenate(fps))
    return run


def _block_keys(fp, first: int, width: int, parts: int) -> list:
    """(part number, bits) of ``width`` bits from ``first`` on, cut into ``parts`` blocks."""
    cut = [first + width * k // parts for k in range(parts + 1)]
    return [F.struct(F.lit(k).alias("part"),
                     F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("bits"))
            for k, (a, b) in enumerate(zip(cut, cut[1:]))]


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    parts = max_bits + 1
    fp = F.col("fp")
    dealt = fps.select("fp", F.explode(F.array(*_block_keys(fp, 0, 64, parts))).alias("k")) \
        .select("fp", F.col("k.part").alias("part"), F.col("k.bits").alias("bits"))
    large = dealt.groupBy("part", "bits").count().where(F.col("count") > bucket_rows).select("part", "bits", F.lit(True).alias("large"))
    dealt = dealt.join(large, ["part", "bits"], "left")
    # a large bucket's pairs agree on one of max_bits + 1 blocks of the other bits as well
    again = F.lit(None)
    for k in range(parts):
        a, b = 64 * k // parts, 64 * (k + 1) // parts
        rest = fp.bitwiseAND(F.lit((1 << a) - 1).cast("bigint")).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b), a)) if b < 64 \
            else fp.bitwiseAND(F.lit((1 << a) - 1).cast("bigint"))
        again = F.when(F.col("part") == k, F.array(*_block_keys(rest, 0, 64 - (b - a), parts))).otherwise(again)
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("bits")))
    sub = F.explode(F.when(F.col("large"), again).otherwise(whole))
    keyed = dealt.select("fp", "part", "bits", sub.alias("s")) \
        .select(F.xxhash64("part", "bits", "s.part", "s.bits").alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links of ``max_bits`` or fewer bits.

    Texts without words (null, empty) share fingerprint 0 and link like any other.  Repeated rows give repeated
    results.  A null id never names a component unless all its members lack one.  An empty table gives no rows;
    other columns are not read."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    root = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row per component: the smallest id, then the smallest text hash; equal rows are one.

    Only ids, fingerprints and text hashes are grouped; the rows themselves are joined once."""
    mark = ["_id", "_h"]
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                         F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    # (id, hash) stands in for the id: smallest id first, rows without id last
    ordered = marked.select(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h").alias("doc"), F.col("_text").alias("text"))
    groups = near_duplicates(ordered, "doc", "text", shingle, max_bits)
    first = groups.select(F.col("component").alias("c")).distinct().select(F.col("c._id").alias("_id2"), F.col("c._h").alias("_h2"))
    kept = marked.drop("_text").join(first, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left_semi")
    # rows equal in id and text: keep one of them
    return kept.dropDuplicates(mark).select("_row.*")
