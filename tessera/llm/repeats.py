"""Shared steps of the exact substring deduplications.

Every window of the target length holds an anchor: the window's rightmost smallest short-window hash
(a minimizer).  Neighbouring windows with one anchor form a run.  Equal windows have equal anchors at equal
places, so only anchors that occur twice can hold repeated windows, and an anchor whose runs are all
equal needs no further look.  What is left, the open runs, goes to the operator's own method.

Tables are filtered by bit tables of a fixed size before they are shuffled; a full bit table lets rows
through that a join then drops, so the size only bears on speed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import arrow_schema, materialize

#: size of a bit table: 4 MB, whatever the size of the input
FILTER_BITS = 1 << 25

KEY = "key bigint, guard int"
RUN = f"{KEY}, anchor bigint, run bigint, pos int, n int, off int, left bigint, right bigint"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, guard, id, text): rows with equal id and text share key and guard, null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.octet_length(text).alias("guard"),
                       F.col(id_col).alias("id"), text.alias("text"))


class BitFilter:
    """Bit table over a column of hashes; a broadcast of fixed size."""

    def __init__(self, df: DataFrame, column: str, bits: int = FILTER_BITS):
        at = F.col(column).bitwiseAND(F.lit(bits - 1).cast("bigint"))
        words = df.select(at.alias("at")).selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b") \
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most bits / 64 rows
        table = np.zeros(bits // 64, np.uint64)
        table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
        self.mask, self.shared = bits - 1, df.sparkSession.sparkContext.broadcast(table)

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """Function for tasks: which hashes may be in the table (the others surely are not)."""
        shared, mask = self.shared, np.uint64(self.mask)

        def may_be(hashes: np.ndarray) -> np.ndarray:
            at = hashes.view(np.uint64) & mask
            return (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return may_be

    def rows(self, column: str, hit: bool = True, then: Callable | None = None) -> Callable:
        """mapInArrow function: the rows whose ``column`` may be in the table (or, with ``hit`` false, surely is
        not), passed through ``then`` in the same Python worker."""
        test = self.test()

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = test(batch.column(batch.schema.get_field_index(column)).to_numpy())
                if not hit:
                    may = ~may
                if may.any():
                    yield batch.filter(pa.array(may))

        return chosen if then is None else lambda batches: then(chosen(batches))

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        return df.mapInArrow(self.rows(column), df.schema)


def anchored_runs(codes: np.ndarray, rows: np.ndarray, base: int, length: int):
    """Runs of the windows of ``length`` items in a ragged array of item codes.

    Returns (prefix hashes, row, first window, windows, anchor position) of every run."""
    prefix = T.prefix_hash(codes)
    sizes = np.diff(rows)
    whole = np.maximum(sizes - length + 1, 0)  # windows of each row; the starts after them run out of it
    if not whole.any():
        empty = np.zeros(0, np.int64)
        return prefix, empty, empty, empty, empty
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([whole, sizes - whole], axis=1).ravel())
    at = T.minimizers(T.window_hashes(prefix, base), length - base + 1)
    inside = inside[:len(at)]
    opens = np.append(True, at[1:] != at[:-1])
    opens[1:] |= ~inside[:-1]
    opens[rows[:-1][whole > 0]] = True
    opens &= inside
    first = np.flatnonzero(opens)
    closes = inside & np.append(opens[1:] | ~inside[1:], True)
    size = np.flatnonzero(closes) - first + 1
    return prefix, np.searchsorted(rows, first, "right") - 1, first, size, at[first]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def run_rows(base: int, length: int, items: Callable, anchors: BitFilter | None = None) -> Callable:
    """mapInArrow function (key, guard, id, text) -> runs; with ``anchors``, those whose anchor may be in the table.

    ``items(data, offs)`` gives the (codes, row offsets) of a block of texts.  ``left`` and ``right`` are the
    anchor extended to twice its length to either side (0 where the text ends before)."""
    out = arrow_schema(RUN)
    test = anchors.test() if anchors else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, guard = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "guard"))
            data, offs = T.string_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in T.blocks(offs):
                codes, rows = items(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                prefix, row, first, size, at = anchored_runs(codes, rows, base, length)
                if not len(row):
                    continue
                anchor = T.range_hash(prefix, at, at + base)
                if test:
                    may = test(anchor)
                    row, first, size, at, anchor = row[may], first[may], size[may], at[may], anchor[may]
                begin, end = rows[row], rows[row + 1]
                left = np.where(at - base >= begin, T.range_hash(prefix, np.maximum(at - base, 0), at + base), np.uint64(0))
                right = np.where(at + 2 * base <= end, T.range_hash(prefix, at, np.minimum(at + 2 * base, len(codes))), np.uint64(0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[a:b][row]), pa.array(guard[a:b][row]), _signed(anchor),
                    _signed(T.range_hash(prefix, first, first + size + length - 1)),
                    pa.array((first - begin).astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array((at - first).astype(np.int32)), _signed(left), _signed(right)], schema=out)
    return run


def repeated_runs(docs: DataFrame, base: int, length: int, items: Callable) -> DataFrame:
    """Runs whose anchor occurs more than once, with ``pure``: all runs of the anchor are equal.

    Counts are combined in the tasks before they are shuffled, so a frequent anchor is one row per task; the
    join back has one row per anchor on one side and can be split on the other."""
    runs = docs.mapInArrow(run_rows(base, length, items), RUN)
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("lo"), F.max("run").alias("hi")) \
        .where("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("pure"))
    anchors = materialize(anchors, "anchors")
    held = docs.mapInArrow(run_rows(base, length, items, BitFilter(anchors, "anchor")), RUN)
    return materialize(held.join(anchors, "anchor"), "runs")


def _candidate_range(length: int, base: int) -> list[Column]:
    """First and past last window of a run that can be repeated, given which extended anchors are.

    The window i of a run has its anchor ``off - i`` items in.  With fewer than ``base`` items before the
    anchor it holds the right extension, with more than ``length - 2 * base`` the left one, else both."""
    first = F.when(F.col("left_again"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("off") - base + 1))
    last = F.when(F.col("right_again"), F.col("n")).otherwise(F.least(F.col("n"), F.col("off") - length + 2 * base))
    return [first.cast("int").alias("i0"), last.cast("int").alias("i1")]


def open_kinds(open_: DataFrame, base: int, length: int) -> DataFrame:
    """(run, key, anchor, i0, i1, weight): the distinct open runs, the text that tells each, the windows that can
    be repeated since an anchor extended to twice its length is, and the number of occurrences (2 for more)."""
    left = open_.groupBy("left").count().where("count > 1").select("left", F.lit(True).alias("left_again"))
    right = open_.groupBy("right").count().where("count > 1").select("right", F.lit(True).alias("right_again"))
    kinds = open_.groupBy("run").agg(
        F.least(F.count(F.lit(1)), F.lit(2)).alias("weight"), F.min("key").alias("key"),
        *[F.max(c).alias(c) for c in ("anchor", "n", "off", "left", "right")])
    return kinds.join(left, "left", "left").join(right, "right", "left") \
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("left_again", "right_again")}) \
        .select("run", "key", "anchor", "weight", *_candidate_range(length, base)).where("i0 < i1")


def per_text(spans: DataFrame, fields: list[str]) -> DataFrame:
    """(key, guard, parts): the distinct rows of each text; a text has no more of them than runs."""
    return spans.groupBy("key", "guard").agg(F.collect_set(F.struct(*fields)).alias("parts"))


def attach(docs: DataFrame, parts: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """``cut`` over all texts: joined with their parts where there may be some, as they are where there are none."""
    bits = BitFilter(parts, "key")
    some = bits.keep(docs, "key").join(parts, ["key", "guard"], "left").select("id", "text", "parts")
    return some.mapInArrow(cut, schema).unionByName(docs.mapInArrow(bits.rows("key", False, cut), schema))
