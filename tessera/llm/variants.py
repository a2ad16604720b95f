"""Grouping of spelling variants: words that differ by one code point, found by dense prefix-suffix tiling.

Two different words are one edit apart exactly when their common prefix and their common suffix together reach the
length of the longer word minus one.  Words are compared in tiles: rows of code-point matrices, padded on the right for
the prefixes and on the left for the suffixes, a block of pairs at a time.

Which words meet in a tile: a word of length l takes part in the size classes l and l + 1 (as the longer, or as the
shorter word of a pair).  The places 0..size are cut into three stretches; the edit falls into one, so the code points
before and after that stretch are equal, and these are the key of a tile.  A pair counts in the tile that holds its first
differing place, so once.  The stretch of a crowded tile is cut again into three, down to single places, where only words
that differ in that place are left.  Counts of keys are combined in the tasks before any row is dealt out, so no task
ever gets the rows of a crowded tile; no pair leaves a task, only sums per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import materialize

#: words of one tile key that are compared at once; a fuller tile is cut by further code points
CROWDED = 256
#: pairs, and matrix cells, compared at once
PAIRS = 1 << 16
CELLS = 1 << 22
#: parts of a stretch
PARTS = 3

MIN_LENGTH, MIN_COUNT = 5, 3


# --------------------------------------------------------------------------- words of texts

def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inside, starts, ends, row offsets): maximal runs of [A-Za-z] and U+00C0..U+00FF, in UTF-8 bytes."""
    inside = np.zeros(256, bool)
    inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0xC3] = True  # C3 leads U+00C0..U+00FF and nothing else
    inside = inside[data]
    inside[1:] |= data[:-1] == 0xC3
    starts, ends, rows = T.words(inside.view(np.uint8), offs, np.array([True] + [False] * 255))
    return inside, starts, ends, rows


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_after(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end] going on from the crc32 ``before`` it, all runs side by side."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    open_, at, left = np.arange(len(starts)), starts.copy(), ends - starts
    for _ in range(64):  # longer runs go on one by one
        alive = left > 0
        if not alive.all():
            open_, at, left = open_[alive], at[alive], left[alive]
        if not len(open_):
            break
        now = state[open_]
        state[open_] = _CRC[(now ^ data[at]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        at, left = at + 1, left - 1
    out = state ^ np.uint32(0xFFFFFFFF)
    for k, a, n in zip(open_.tolist(), at.tolist(), left.tolist()):
        out[k] = zlib.crc32(data[a:a + n].tobytes(), int(out[k]))
    return out


def misspell(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray, every: int):
    """Runs whose ``crc`` is divisible by ``every`` lose code point crc % length: (inside, byte lengths) after it."""
    lengths = ends - starts
    chosen = np.flatnonzero(crc % np.uint32(every) == 0)
    if not len(chosen):
        return inside, lengths
    first = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
    begin = np.searchsorted(first, starts[chosen])
    size = np.searchsorted(first, ends[chosen]) - begin
    at = first[begin + crc[chosen].astype(np.int64) % size]
    width = 1 + (data[at] == 0xC3)
    inside, lengths = inside.copy(), lengths.copy()
    inside[at] = False
    inside[at[width == 2] + 1] = False
    lengths[chosen] -= width
    return inside, lengths


_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _word_counter(every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = T.lower_ascii()
        for batch in T.slices(batches, 8192):
            parts = []
            data, offs = T.string_bytes(batch.column(1))
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()] if every else []
            for a, b in T.blocks(offs, 4 * T.BLOCK_BYTES):
                part, local = lower[data[offs[a]:offs[b]]], offs[a:b + 1] - offs[a]
                inside, starts, ends, rows = letter_runs(part, local)
                lengths = ends - starts
                if every and len(starts):
                    crc = crc_after(part, starts, ends, np.repeat(np.array(ids[a:b], np.uint32), np.diff(rows)))
                    inside, lengths = misspell(part, inside, starts, ends, crc, every)
                found = T.strings(part[inside], lengths)
                found = found.filter(pc.greater_equal(pc.utf8_length(found), least))
                counted = found.value_counts()
                parts.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
            if parts:
                whole = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
                for out in whole.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(_WORDS).to_batches():
                    yield out
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, misspell_every: int = 0) -> DataFrame:
    """(word, n): lower-cased (A-Z) letter runs of at least ``min_length`` code points that occur ``min_count`` times.

    ``misspell_every`` k > 0 takes out one code point of each run whose crc32 with its document's id (a null id: the
    empty string) is divisible by k, to plant variants.  Null and empty texts have no words; repeated rows count each;
    a text or run of any length is read whole; other columns are not read."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = kept.mapInArrow(_word_counter(misspell_every, min_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------- tiles

def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    data, offs = T.string_bytes(words)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offs]


_ROW = "key bigint, size int, start int, stop int, word string, n bigint"
_TILE = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("word", pa.string()), ("n", pa.int64())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each row's stretch into parts: a row per part, with the key of what is equal outside of it."""
    for batch in T.slices(batches, 1 << 14):
        if not len(batch):
            continue
        size, start, stop = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
        points, offs = code_points(batch.column(4))
        prefix = T.prefix_hash(T.mix(points.astype(np.uint64) + np.uint64(1)))
        length = np.diff(offs)
        rows, begin, end = [], [], []
        for k in range(PARTS):
            a, b = start + (stop - start) * k // PARTS, start + (stop - start) * (k + 1) // PARTS
            keep = np.flatnonzero(b > a)
            rows.append(keep)
            begin.append(a[keep])
            end.append(b[keep])
        rows, begin, end = np.concatenate(rows), np.concatenate(begin), np.concatenate(end)
        f, n, whole = offs[rows], length[rows], size[rows]
        before = T.range_hash(prefix, f, f + np.minimum(begin, n))
        after = T.range_hash(prefix, f + np.maximum(n - (whole - end), 0), f + n)
        place = ((whole.astype(np.uint64) << np.uint64(42)) ^ (begin.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64))
        key = T.mix(T.mix(before + T.mix(place)) * np.uint64(3) + after)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()),
                                          batch.column(4).take(take), batch.column(5).take(take)], schema=_TILE)


def _padded(points: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows of a matrix from the left, and once more from the right (last code point first)."""
    length = np.diff(offs)
    kind = np.uint8 if len(points) == 0 or points.max() < 0xFF else np.uint32
    place = np.arange(len(points)) - np.repeat(offs[:-1], length)
    row = np.repeat(np.arange(len(length)), length)
    left, right = np.zeros((len(length), width + 1), kind), np.zeros((len(length), width + 1), kind)
    left[row, place] = points + 1
    right[row, np.repeat(length, length) - 1 - place] = points + 1
    left[:, width] = right[:, width] = 0
    return left, right


def _common(matrix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows i and j (different words differ before the padding ends)."""
    return np.argmin(matrix[i] == matrix[j], axis=1)


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())])


def near_in_tiles(key, size, start, stop, words: pa.Array, n: np.ndarray):
    """Sums per word over the near pairs of whole tiles (rows sorted by key): rows, near words, best near row."""
    points, offs = code_points(words)
    length = np.diff(offs)
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]), [True]]))
    last = np.repeat(edge[1:], np.diff(edge))
    partners = last - np.arange(len(key)) - 1
    found_i, found_j = [], []
    cost = np.zeros(len(key) + 1, np.int64)
    np.cumsum(partners, out=cost[1:])
    for a, b in T.blocks(cost, PAIRS):
        if cost[a] == cost[b]:
            continue
        top = int(last[a:b].max())
        width = int(size[a:top].max())
        left, right = _padded(points[offs[a]:offs[top]], offs[a:top + 1] - offs[a], width)
        times = partners[a:b]
        step = max(1, CELLS // (width + 1))
        for c in range(0, int(times.sum()), step):  # long words: fewer pairs at once
            pair = np.arange(c, min(c + step, int(times.sum())))
            i = np.searchsorted(cost[a:b + 1] - cost[a], pair, "right") - 1
            j = i + 1 + pair - (cost[a + i] - cost[a])
            fits = np.maximum(length[a + i], length[a + j]) == size[a + i]
            i, j = i[fits], j[fits]
            same = _common(left, i, j)
            fits = (same >= start[a + i]) & (same < stop[a + i])
            i, j, same = i[fits], j[fits], same[fits]
            fits = same + _common(right, i, j) >= size[a + i] - 1
            found_i.append(i[fits] + a)
            found_j.append(j[fits] + a)
    if not found_i:
        return (np.zeros(0, np.int64),) * 3
    one, other = np.concatenate(found_i + found_j), np.concatenate(found_j + found_i)
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    rows, first, near = np.unique(one, return_index=True, return_counts=True)
    return rows, near, other[first]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> per word and tile group its number of near words and the best of them."""

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table) < 2:
            return
        words = table.column("word").combine_chunks()
        key, size, start, stop, n = (table.column(c).to_numpy() for c in ("key", "size", "start", "stop", "n"))
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        keep = np.flatnonzero(shared)  # a word alone in its tile has no partner there
        order = keep[np.lexsort((stop[keep], start[keep], size[keep], key[keep]))]
        words = words.take(pa.array(order))
        rows, near, best = near_in_tiles(key[order], size[order], start[order], stop[order], words, n[order])
        if len(rows):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(rows)), pa.array(near, pa.int64()), pa.array(-n[order][best]), words.take(pa.array(best))], schema=_NEAR)

    rest = _TILE.empty_table()
    for batch in batches:
        if not len(batch):
            continue
        table = pa.concat_tables([rest, pa.Table.from_batches([batch.cast(_TILE)])]).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        yield from results(table.slice(0, cut))
        rest = table.slice(cut)
    yield from results(rest)


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, n_near, form, form_n): for each word with near words their number and the most frequent of them.

    ``words`` (word, n) holds different words, none null; near words differ by exactly one inserted, deleted or replaced
    code point.  Equal counts: the smaller word in code-point order."""
    length = F.length("word").cast("int")
    open_ = words.withColumn("size", F.explode(F.array(length, length + 1))).where(F.col("size") > 0).select(
        F.lit(0).cast("bigint").alias("key"), "size", F.lit(0).alias("start"), F.col("size").alias("stop"), "word", "n")
    sums = None
    while True:
        rows = open_.mapInArrow(_keys, _ROW)
        counts = rows.where(F.col("stop") - F.col("start") > 1).groupBy("key").count().where(F.col("count") > crowded).select("key")
        full = materialize(counts, "variants-crowded")
        found = rows.join(full, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "word string, n_near bigint, less bigint, form string")
        found = materialize(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best")), "variants-near")
        sums = found if sums is None else sums.union(found)
        if full.isEmpty():
            break
        open_ = materialize(rows.join(full, "key", "left_semi").select(*[c.split()[0] for c in _ROW.split(", ")]), "variants-open")
    best = F.min("best").alias("best")
    return sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


# --------------------------------------------------------------------------- forms

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms.  A form must be more frequent than its word,
    by a factor of two here, so that chains end and are short; each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n).

    A word's form is its near word of largest n if that is at least ``ratio`` times its own n (null otherwise); root
    follows the forms to the last.  A null word is left out; a repeated word counts once, with the sum of its n; an empty
    table gives an empty table; extra columns are not read.  Words of any length are compared whole."""
    words = materialize(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "variants-words")
    near = near_words(words, crowded)
    strong = F.col("form_n") >= ratio * F.col("n")
    judged = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")), "variants-forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: runs that lose a code point in the registered query: one in so many
MISSPELL_EVERY = 97


def digest(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts."""
    found = group_variants(count_words(docs, misspell_every=MISSPELL_EVERY))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
